"""Cross-entropy difference: two word n-gram models over one vocabulary score each document.

Tokens are words (letters and digits, A-Z as a-z). The shared vocabulary is every word of the corpus, so the models have the
same support; a word of neither falls to a uniform share. Each model counts the n-grams of orders 1 to `orders`: the
background over all documents, the target over those whose ids are in a table. A score is a document's loss under the target
model less its loss under the background model, in bits a token: the lower, the more it is like the target.

The models are matched: background counts are weighed by the ratio of the models' tokens, so both hold equally much evidence
and the difference shows what they saw, not how much. No document is scored by a model that was fitted on it: its own
counts are taken off before its loss is computed, in both models. (`own=False` scores documents that are not of the corpus.)

Counts are exact. An n-gram is a 64-bit hash of its words; the model is a written table in the size of the corpus's
distinct n-grams, in parts of about PART n-grams by hash, and is nowhere held as a whole. Documents are dealt into slices of SLICE
bytes. A slice sends each part its distinct n-grams, as one row of packed numbers; a part merges what it is sent; for
scoring it answers each slice in the order asked. Frequent n-grams cost one number a slice, so no key is hot.

Smoothing: p1 = (c + ALPHA) / (total + ALPHA * vocabulary), and at higher orders p = (c + KAPPA * lower) / (context + KAPPA).

Defined cases: null and empty texts and those without a word have no losses and no score (null) and 0 tokens; with no target
document the target model knows nothing and all its words are equally likely; equal ids stay separate rows; a null id is never
of the target.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.batches import ALNUM, Words, mix, segment_sum, utf8
from stratalog.llm.shared import discard, give_back, small_batches, written

ORDERS, ALPHA, KAPPA = 2, 0.5, 1.0
SLICE, PART = 2 << 20, 600_000
#: ids up to which a lookup table is broadcast; more are joined by shuffle
BROADCAST_IDS = 1_000_000


class Grams:
    """The n-grams of a slice: for each order the sorted distinct keys (a hash whose last bits are the order less 1), and for
    each word the index of the n-gram that ends there, -1 where it would begin before its document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, orders: int):
        self.words = words = Words(raw, offsets, ALNUM)
        place = np.arange(len(words.hash)) - words.first[:-1][words.doc] if len(words.hash) else np.zeros(0, np.int64)
        self.keys, self.index = [], []
        own = words.hash
        for n in range(1, orders + 1):
            if n > 1:
                own = np.append(np.zeros(1, np.uint64), mix(own[:-1] * np.uint64(3) + words.hash[1:]))[: len(own)]
            at = np.flatnonzero(place >= n - 1)
            keys, index = np.unique(own[at] & ~np.uint64(3) | np.uint64(n - 1), return_inverse=True)
            whole = np.full(len(own), -1, np.int64)
            whole[at] = index
            self.keys.append(keys)
            self.index.append(whole)

    def dealt(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of all orders, where each part's begin (parts are ranges of keys), and the order that sorts them."""
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        begins = np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)
        return keys[order], np.append(np.searchsorted(keys[order], begins), len(keys)), order


def _pack(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64) if data else np.zeros(0, np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in as many bytes each as the largest needs, all first bytes together and so on."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


@dataclass
class Models:
    """Written n-gram counts (part, words, tokens, target_tokens, keys, background, target), what the smoothing needs, and the
    target's ids."""

    table: DataFrame | None
    parts: int
    orders: int
    vocabulary: int
    totals: tuple[int, int]
    target: DataFrame | None


def _cut(docs: DataFrame, id_col: str, text_col: str, target: DataFrame | None, slice_bytes: int) -> DataFrame:
    """(slice, bytes, rows), written: doc_id, text and is_target of about slice_bytes of text in each row, compressed."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if target is None:
        rows = rows.withColumn("is_target", F.lit(False))
    else:
        ids = target.select(F.col(target.columns[0]).alias("doc_id")).filter("doc_id is not null").distinct()
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        ids = ids.withColumn("is_target", F.lit(True))
        rows = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))

    def run(batches):
        now, held, filled = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            b = pa.record_batch({"doc_id": b.column("doc_id"), "text": b.column("text").cast(pa.large_string()), "is_target": b.column("is_target")})
            a = 0
            for k, n in enumerate(np.diff(utf8(b.column("text"))[1]).tolist()):
                if filled and filled + n > slice_bytes:
                    yield _slice(now, filled, [*held, b.slice(a, k - a)])
                    now, held, filled, a = now + 1, [], 0, k
                filled += n
            held.append(b.slice(a))
        if sum(h.num_rows for h in held):
            yield _slice(now, filled, held)

    return written(rows.mapInArrow(run, "slice long, bytes long, rows binary"), "slices")


def _slice(number: int, size: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(batches).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(whole)
    return pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int64()), "bytes": pa.array([size], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _rows(data: bytes) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Ids, texts and target marks of a slice."""
    t = pa.ipc.open_stream(data).read_all().combine_chunks()
    ids, texts, wanted = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns)
    return ids, texts, wanted.to_numpy(zero_copy_only=False).astype(bool)


def _asked(dealt: DataFrame, parts: int, orders: int, counted: bool) -> DataFrame:
    """(part, slice, keys, background, target): a slice's distinct n-grams in each part, with its counts if wanted."""

    def run(batches):
        for b in batches:
            for now, data in zip(b.column("slice").to_pylist(), b.column("rows")):
                _, texts, wanted = _rows(data.as_py())
                grams = Grams(*utf8(texts), orders)
                keys, cuts, order = grams.dealt(parts)
                some = np.flatnonzero(np.diff(cuts))
                out = {"part": pa.array(some), "slice": pa.array(np.full(len(some), now)), "keys": pa.array([_pack_keys(keys[cuts[p] : cuts[p + 1]]) for p in some], pa.binary())}
                if counted:
                    mask = wanted[grams.words.doc]
                    for name, ok in (("background", np.ones(len(mask), bool)), ("target", mask)):
                        c = np.concatenate([np.bincount(i[ok & (i >= 0)], minlength=len(k)) for k, i in zip(grams.keys, grams.index)])[order]
                        out[name] = pa.array([_pack(c[cuts[p] : cuts[p + 1]]) for p in some], pa.binary())
                yield pa.RecordBatch.from_pydict(out)
                del grams, keys, order, out
                give_back(False)

    return dealt.select("slice", "rows").mapInArrow(run, "part long, slice long, keys binary" + ", background binary, target binary" * counted)


def _column(table: pa.Table, name: str) -> list[bytes]:
    return [x.as_py() for x in table.column(name)]


MERGED = {"part": pa.int64(), "slice": pa.int64(), "words": pa.int64(), "tokens": pa.int64(), "target_tokens": pa.int64(), "keys": pa.binary(), "background": pa.binary(), "target": pa.binary()}


def _merged(dealt: DataFrame, orders: int, kept: bool, answers: bool) -> tuple[DataFrame, int, tuple]:
    """A written table of parts, how many there are, and the sums of words, tokens and target's tokens. A part has a row without
    a slice, with its n-grams if they are to be kept, and if wanted one for each slice, with the counts of what that asked."""
    size = dealt.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(1, -(-size * orders // (6 * PART)))  # about six bytes a word

    def merge(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        sent = [_unpack_keys(k) for k in _column(own, "keys")]
        keys, which = np.unique(np.concatenate(sent), return_inverse=True)
        sums = {name: np.bincount(which, np.concatenate([_unpack(c) for c in _column(own, name)]), len(keys)).astype(np.int64) for name in ("background", "target")}
        single = (keys & np.uint64(3)) == 0
        out = [{"slice": None, "words": int(single.sum()), "tokens": int(sums["background"][single].sum()), "target_tokens": int(sums["target"][single].sum())}]
        if kept:
            out[0] |= {"keys": _pack_keys(keys)} | {name: _pack(c) for name, c in sums.items()}
        if answers:
            cuts = np.append(0, np.cumsum([len(k) for k in sent]))
            for s, a, b in zip(own.column("slice").to_pylist(), cuts, cuts[1:]):
                out.append({"slice": s} | {name: _pack(c[which[a:b]]) for name, c in sums.items()})
        return pa.table({c: pa.array([key[0].as_py() if c == "part" else r.get(c) for r in out], t) for c, t in MERGED.items()})

    counts = _asked(dealt, parts, orders, True).groupBy("part").applyInArrow(merge, "part long, slice long, words long, tokens long, target_tokens long, keys binary, background binary, target binary")
    table = written(counts, "ngrams")
    return table, parts, tuple(x or 0 for x in table.agg(F.sum("words"), F.sum("tokens"), F.sum("target_tokens")).first())


def fit(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS, slice_bytes: int = SLICE) -> Models:
    """The models of all docs and of those whose ids are in target's first column."""
    dealt = _cut(docs, id_col, text_col, target, slice_bytes)
    table, parts, (words, *totals) = _merged(dealt, orders, True, False)
    discard(docs.sparkSession, dealt)
    return Models(table, parts, orders, words, tuple(totals), target)


def losses(grams: Grams, counts: list[list[np.ndarray]], models: Models, wanted: np.ndarray, own: bool) -> np.ndarray:
    """Two x documents: bits of each whole document under background and target; counts[m][n] are those of grams.keys[n]."""
    words = grams.words
    out = []
    matched = models.totals[1] / models.totals[0] if models.totals[1] and models.totals[0] else 1.0
    mine = []  # of the n-gram that ends at each word, how many are the document's own
    for keys, index in zip(grams.keys, grams.index):
        at = np.flatnonzero(index >= 0)
        c = np.zeros(len(index))
        if own and len(at):
            _, back, n = np.unique(words.doc[at] * len(keys) + index[at], return_inverse=True, return_counts=True)
            c[at] = n[back]
        mine.append(c)
    for total, known, weight, less in ((models.totals[0], counts[0], matched, np.ones(len(words.hash))), (models.totals[1], counts[1], 1.0, wanted.astype(float)[words.doc])):
        p, before = None, None
        for n, index in enumerate(grams.index):
            ok = index >= 0
            c = np.zeros(len(index))
            c[ok] = weight * (known[n][index[ok]] - (less * mine[n])[ok])
            c = np.maximum(c, 0)
            if n == 0:
                rest = weight * np.maximum(total - own * less * words.counts[words.doc], 0)
                p = (c + ALPHA) / (rest + ALPHA * max(models.vocabulary, 1))
            else:
                context = np.append(np.zeros(1), before[:-1])[: len(before)]  # the n-gram that ends a word earlier
                p = np.where(ok, (c + KAPPA * p) / (np.maximum(context, c) + KAPPA), p)
            before = c
        out.append(segment_sum(-np.log2(p), words.first))
    return np.array(out)


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE, own: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, target_loss, background_loss and score, in bits a token. `own`: docs are what the models
    were fitted on."""
    dealt = _cut(docs, id_col, text_col, models.target, slice_bytes)

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("part", pa.int64()), ("slice", pa.int64()), ("background", pa.binary()), ("target", pa.binary()))})
        keys = _unpack_keys(_column(known, "keys")[0]) if known.num_rows else np.zeros(0, np.uint64)
        counts = {name: _unpack(_column(known, name)[0]) if known.num_rows else np.zeros(0, np.int64) for name in ("background", "target")}
        got = {"background": [], "target": []}
        for k in _column(asked, "keys"):
            k = _unpack_keys(k)
            at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
            for name, c in counts.items():
                got[name].append(_pack(np.where(keys[at] == k, c[at], 0) if len(keys) else np.zeros(len(k), np.int64)))
        return pa.table({"part": asked.column("part"), "slice": asked.column("slice")} | {n: pa.array(v, pa.binary()) for n, v in got.items()})

    asked = _asked(dealt, models.parts, models.orders, False)
    known = models.table.select("part", "keys", "background", "target")
    answers = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answer, "part long, slice long, background binary, target binary")
    return _judged(docs, id_col, dealt, answers, models, own)


def _judged(docs: DataFrame, id_col: str, dealt: DataFrame, answers: DataFrame, models: Models, own: bool) -> DataFrame:
    few = Models(None, models.parts, models.orders, models.vocabulary, models.totals, None)

    def judge(rows: pa.Table, known: pa.Table) -> pa.Table:
        ids, texts, wanted = _rows(rows.column("rows")[0].as_py())
        known = known.sort_by("part")
        grams = Grams(*utf8(texts), few.orders)
        _, _, order = grams.dealt(few.parts)
        counts = []
        for name in ("background", "target"):
            flat = np.zeros(len(order))
            flat[order] = np.concatenate([_unpack(c) for c in _column(known, name)]) if known.num_rows else 0
            counts.append(np.split(flat, np.cumsum([len(k) for k in grams.keys])[:-1]))
        n = grams.words.counts
        bits = losses(grams, counts, few, wanted, own) / np.maximum(n, 1)
        del grams, counts, flat, order
        give_back(False)
        none = n == 0
        return pa.table({"doc_id": ids, "n_tokens": pa.array(n, pa.int64())} | {k: pa.array(v, pa.float64(), mask=none) for k, v in (("target_loss", bits[1]), ("background_loss", bits[0]), ("score", bits[1] - bits[0]))})

    kind = dict(docs.dtypes)[id_col]
    return dealt.select("slice", "rows").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(judge, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS, slice_bytes: int = SLICE) -> DataFrame:
    """score() of docs by the models of the same docs. What a slice sends to be counted is also what it asks for, so parts
    answer as they merge, and the n-grams are sent once and not kept."""
    dealt = _cut(docs, id_col, text_col, target, slice_bytes)
    table, parts, (words, *totals) = _merged(dealt, orders, False, True)
    models = Models(None, parts, orders, words, tuple(totals), target)
    return _judged(docs, id_col, dealt, table.filter("slice is not null").select("part", "slice", "background", "target"), models, True)
