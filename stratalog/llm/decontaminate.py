"""Benchmark decontamination with suffix arrays over the training text.

Each slice of documents becomes a shard with its own suffix array: the positions of all its words, sorted by the words from
there to the end of their document. Every suffix of every benchmark item that holds a whole window is searched for in it by
bisection, unless the shard lacks a word of the window; all such suffixes take their steps together. Where the shard has the suffix's window, the range of the array that
begins with it gives every place of it, and the common prefix of the two texts there is the verbatim match, which may
go on beyond the window. A document's longest match is the longest of these (ties: the first item, the place in it, the
place in the document).

The map runs in one pass over the documents, with no shuffle. The benchmark, without rows that repeat both id and text, is cut into blocks of at most `block_bytes`
of text, collected and broadcast one after another: the rows with what was found so far are written between two blocks, and
a block is let go before the next is read, so driver and workers hold one block however large the benchmark is.

Defined cases: null and empty texts have no words and no hits; an item without words has no window; an
item of fewer words than a window is one window; rows with equal ids stay separate rows; an item whose
id is null hits words but isn't listed; rows of the benchmark that repeat an id are one item there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.batches import ALNUM, SLICE_BYTES, Words, slices, utf8
from stratalog.llm.shared import discard, give_back, small_batches, written

WINDOW = 10
BLOCK_BYTES = 32_000_000
#: text of documents in one suffix array: as a search goes through the whole block, a 16th of its size within these bounds
LEAST_SHARD, MOST_SHARD = SLICE_BYTES, 2_000_000
FOUND = "n_words long, spans array<bigint>, items array<bigint>, match_words long, match_item bigint, match_item_word long, match_word long"


class Items:
    """The words of a block of benchmark items, and the suffixes to search for: those that hold a whole window."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0))
        ids, texts = [ids[k] for k in order], [texts[k] for k in order]
        raw, offsets = utf8(pa.array(texts, pa.large_string()))
        words = Words(raw, offsets, ALNUM)
        self.item, self.first, self.bytes = words.doc, words.first, len(raw)
        #: the distinct words, and which of them each word is
        self.distinct, self.which = np.unique(words.hash, return_inverse=True)
        self.names = np.array([0 if i is None else i for i in ids], np.int64)
        self.named = np.array([i is not None for i in ids], bool)
        n = np.arange(len(words.hash))
        end = words.first[1:][words.doc]
        least = np.minimum(words.counts, window)[words.doc]
        #: places of the suffixes, how long their window is, and where their item ends
        self.at = np.flatnonzero(end - n >= least)
        self.length, self.end = least[self.at], end[self.at]

    def __len__(self) -> int:
        return len(self.at)


class Shard:
    """The suffix array of a slice of documents."""

    def __init__(self, words: Words):
        self.words = words
        self.vocabulary, codes = np.unique(words.hash, return_inverse=True)
        # each document ends with a mark of its own, less than any word, so no two suffixes are equal and none runs on
        n_docs, n = words.n_docs, len(words.hash)
        self.codes = np.zeros(n + n_docs, np.int32)
        self.place = np.arange(n) + words.doc  # where each word stands among words and marks
        self.codes[self.place] = 2 * codes + 1 + 2 * n_docs
        ends = words.first[1:] + np.arange(n_docs)
        self.codes[ends] = 2 * np.arange(n_docs)
        self.array = suffix_array(self.codes)[n_docs:]  # without those of the marks alone, which come first

    def coded(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """Codes that sort with the shard's own, a word that the shard lacks has one between two of these; and the suffixes whose
        windows have none of those."""
        at = np.searchsorted(self.vocabulary, items.distinct)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == items.distinct
        codes = (2 * at + known + 2 * self.words.n_docs).astype(np.int32)[items.which]
        lacking = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(~known[items.which], out=lacking[1:])
        return codes, np.flatnonzero(lacking[items.at + items.length] == lacking[items.at])

    def _bound(self, codes: np.ndarray, at: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        """By bisection: how many suffixes sort before the words codes[at : at + length], or not after them."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.array))
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            mine, theirs = self.array[middle], at[open_]
            less = np.full(len(open_), after)  # the suffix sorts before; one that begins with the words: as wanted
            going = np.arange(len(open_))
            for k in range(int(length[open_].max())):
                a, b = self.codes[mine[going] + k], codes[theirs[going] + k]
                differ = a != b
                less[going[differ]] = a[differ] < b[differ]
                going = going[~differ]
                going = going[length[open_[going]] > k + 1]
                if not len(going):
                    break
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        return low

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All places of all windows, with the whole match there: word in the shard, suffix, words that match."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(items) or not len(self.array):
            return none
        codes, found = self.coded(items)
        low = self._bound(codes, items.at[found], items.length[found], False)
        # of the suffixes that have a first candidate, those whose window stands there
        found, low = found[low < len(self.array)], low[low < len(self.array)]
        there = self._same(self.array[low], codes, items.at[found], items.length[found]) == items.length[found]
        found, low = found[there], low[there]
        if not len(found):
            return none
        high = self._bound(codes, items.at[found], items.length[found], True)
        hits = high - low
        which = np.repeat(found, hits)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
        place = self.array[rank]
        more = self._same(place, codes, items.at[which], (items.end - items.at)[which], items.length[which])
        return np.searchsorted(self.place, place), which, more

    def _same(self, mine: np.ndarray, codes: np.ndarray, theirs: np.ndarray, most: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The common prefixes, at most `most` words, of which `known` are known to be common."""
        out = np.zeros(len(mine), np.int64) if known is None else known.copy()
        going = np.flatnonzero(out < most)
        while len(going):
            going = going[self.codes[mine[going] + out[going]] == codes[theirs[going] + out[going]]]
            out[going] += 1
            going = going[out[going] < most[going]]
        return out


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The places of codes in the order of what follows from there, by doubling: a round sorts only those that as many
    codes as are compared by then don't tell apart. No two suffixes may be equal up to their end."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int64)
    # the first rounds are one sort, of as many codes as a number holds
    bits = int(rank.max() + 1).bit_length()
    take = min(4, 63 // bits)
    key, padded = np.zeros(n, np.int64), np.append(rank + 1, np.zeros(take, np.int64))
    for k in range(take):
        key = key << bits | padded[k : k + n]
    array = np.argsort(key, kind="stable")
    new = np.append(True, key[array][1:] != key[array][:-1])
    step = take
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]  # a place's rank is where its group begins
    rank[array] = begin
    at = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the array that aren't alone
    while len(at):
        own = array[at]
        follow = own + step
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        order = np.lexsort((second, rank[own]))
        own, second, first = own[order], second[order], rank[own][order]
        array[at] = own
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        rank[own] = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        at = at[~(new & np.append(new[1:], True))]
        step *= 2
    return array


def found_in(column: pa.Array, items: Items) -> Iterator[tuple[int, dict | None]]:
    """For each document: its number of words, and what was found in it, if anything."""
    raw, offsets = utf8(column)
    for a, b in slices(offsets, min(max(items.bytes // 16, LEAST_SHARD), MOST_SHARD)):
        words = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
        pos, which, match = Shard(words).search(items) if len(items) else (np.zeros(0, np.int64),) * 3
        found: dict[int, dict] = {}
        if len(pos):
            doc = words.doc[pos]
            order = np.lexsort((pos, doc))
            pos, which, match, doc = pos[order], which[order], match[order], doc[order]
            cut = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
            for x, y in zip(cut[:-1], cut[1:]):
                found[int(doc[x])] = _report(pos[x:y] - words.first[doc[x]], which[x:y], match[x:y], items)
        for d in range(b - a):
            yield int(words.counts[d]), found.get(d)


def _report(pos: np.ndarray, which: np.ndarray, match: np.ndarray, items: Items) -> dict:
    reach = np.maximum.accumulate(pos + items.length[which])
    new = np.append(True, pos[1:] > reach[:-1])
    spans = np.stack([pos[new], np.append(reach[:-1][new[1:]], reach[-1])], 1).reshape(-1)
    rows = np.unique(items.item[items.at[which]])
    k = np.lexsort((pos, which, -match))[0]  # suffixes are in the order of items and their words
    row = int(items.item[items.at[which[k]]])
    return {
        "spans": spans.tolist(), "items": np.unique(items.names[rows[items.named[rows]]]).tolist(), "match_words": int(match[k]),
        "match_item": int(items.names[row]) if items.named[row] else None, "match_item_word": int(items.at[which[k]] - items.first[row]), "match_word": int(pos[k]),
    }


def _merge(old: dict | None, new: dict | None) -> dict | None:
    if not old or not new:
        return old or new
    spans, out = sorted(zip([*old["spans"][::2], *new["spans"][::2]], [*old["spans"][1::2], *new["spans"][1::2]])), []
    for a, b in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    best = min(old, new, key=lambda x: (-x["match_words"], x["match_item"] is None, x["match_item"], x["match_item_word"], x["match_word"]))
    return best | {"spans": out, "items": sorted({*old["items"], *new["items"]})}


def blocks(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple]:
    """(broadcast items, is it the last) for one block of about block_bytes of benchmark text after another. A block is let go
    when the next is asked for."""
    small_batches(bench.sparkSession)
    spark = bench.sparkSession
    rows = bench.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        got = part.collect()  # about block_bytes
        block = spark.sparkContext.broadcast(Items([r.i for r in got], [r.t for r in got], window))
        yield block, k == n - 1
        if k < n - 1:
            block.unpersist(blocking=False)


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words; spans (start and end word of each hit stretch, in turn); the ids of the items
    that hit it; and its longest verbatim match: words, item, and first word in item and document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    before = None
    for block, last in blocks(bench, window=window, block_bytes=block_bytes):
        def run(batches, block=block, first=before is None, last=last):
            for b in batches:
                found = list(found_in(b.column("text"), block.value))
                if not first:
                    old = b.select(["spans", "items", "match_words", "match_item", "match_item_word", "match_word"]).to_pylist()
                    found = [(n, _merge(x if x["spans"] else None, y)) for x, (n, y) in zip(old, found)]
                get = lambda name, none, found=found: [f[name] if f else none for _, f in found]
                out = {"doc_id": b.column("doc_id")} | ({} if last else {"text": b.column("text")})
                out |= {"n_words": pa.array([n for n, _ in found], pa.int64()), "spans": pa.array(get("spans", []), pa.list_(pa.int64())), "items": pa.array(get("items", []), pa.list_(pa.int64()))}
                out |= {c: pa.array(get(c, 0 if c == "match_words" else None), pa.int64()) for c in ("match_words", "match_item", "match_item_word", "match_word")}
                yield pa.RecordBatch.from_pydict(out)

        rows = rows.mapInArrow(run, f"doc_id {kind}, " + ("" if last else "text string, ") + FOUND)
        if not last:
            old, before = before, written(rows, "found")
            rows = before
            if old is not None:
                discard(rows.sparkSession, old)
    return rows


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, whatever their columns, that hold no window of the benchmark."""
    before = None
    for block, last in blocks(bench, window=window, block_bytes=block_bytes):
        def run(batches, block=block, at=docs.columns.index(text_col)):
            for b in batches:
                yield b.filter(pa.array([f is None for _, f in found_in(b.column(at), block.value)], pa.bool_()))
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            old, before = before, written(docs, "clean")
            docs = before
            if old is not None:
                discard(docs.sparkSession, old)
    return docs


def report(found: DataFrame) -> DataFrame:
    """The columns of the query from those of matches()."""
    hit = F.expr("aggregate(sequence(0, cast(size(spans) / 2 as int) - 1), 0L, (s, i) -> s + spans[2 * i + 1] - spans[2 * i])")
    n_hit = F.when(F.size("spans") > 0, hit).otherwise(F.lit(0)).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
