"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form that each should take.

A word of L code points has two segments, its first L // 2 and the rest. One edit leaves one of them as it is, so of two near
words the one begins or ends with a segment of the other. The segments of all words are dealt over shards by their
outermost ANCHOR code points; a shard has an Aho-Corasick automaton over its own segments. Every word goes to the shards
that can hold a segment of it, by its own first and last code points, and is scanned there: a hit counts if the
segment lies at the word's beginning (first halves) or end (second halves) and belongs to words at most one shorter or longer.
Under a hit only words that agree with the scanned word in what is left but one code point are looked at,
and the distance of each is verified. A pair that both segments show is counted by the first.

A shard passes on one row a word and piece: how many are near, and the most frequent; Spark merges them. Segments with
equal anchors make a group; one of more than PIECE words is dealt to several pieces by a hash of the word, and the words that are
scanned go to each of them. A piece is held as a whole, what is scanned is streamed.

Defined cases: a null or empty text has no words, a null id counts as the empty text; repeated rows count each; ties of
frequency go to the smaller word by code points; an empty table gives no rows; other columns, of whatever names, are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.shared import HOT_KEYS, discard, salted_join, small_batches, written

LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: code points of a segment that tell its shard, and words of a group in one automaton
ANCHOR, PIECE = 3, 20_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "[A-Za-z\\u00C0-\\u00FF]+"

_FOUND = "word string, n_near long, form string, form_n long"


def words(docs: DataFrame, misspelt: int | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word and n over all texts: runs of letters, A-Z lower-cased. With `misspelt`, a run loses a code point where the crc32 of
    `id:run`, h, is a multiple of it: the one at h % length."""
    run = F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))
    own = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(run).alias("_run"))
    word = F.translate("_run", UPPER, UPPER.lower())
    if misspelt:
        own = own.withColumn("_run", word).withColumn("_h", F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), F.col("_run"))))
        at = F.pmod("_h", F.length("_run")).cast("int")
        word = F.when(F.col("_h") % misspelt == 0, F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))).otherwise(F.col("_run"))
    return own.select(word.alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _rests(rest: str) -> set[str]:
    """rest, and what it is without one of its code points."""
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


class _Shard:
    """An automaton over the segments of one side (0 first halves, 1 second halves) of some words."""

    def __init__(self, side: int):
        import ahocorasick

        self.side, self.automaton, self.built = side, ahocorasick.Automaton(), False

    def add(self, word: str, n: int) -> None:
        cut = len(word) // 2
        segment, rest = (word[cut:], word[:cut]) if self.side else (word[:cut], word[cut:])
        under = self.automaton.get(segment, None)
        if under is None:
            under = (len(segment), {})
            self.automaton.add_word(segment, under)
        for r in _rests(rest):
            under[1].setdefault(r, []).append((word, n))

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words of the shard near to `word`, each once over both sides."""
        if not self.built:
            if not len(self.automaton):
                return
            self.automaton.make_automaton()
            self.built = True
        size = len(word)
        for end, (length, under) in self.automaton.iter(word):
            if end != (size - 1 if self.side else length - 1):
                continue
            rest = word[: size - length] if self.side else word[length:]
            seen = {own for r in _rests(rest) for own in under.get(r, ())}
            for other, n in seen:
                # the first half has shown it already
                if abs(len(other) - size) <= 1 and _one_edit(word, other) and not (self.side and word.startswith(other[: len(other) // 2])):
                    yield other, n


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, segments (kind 0) before the words to scan (kind 1)."""
    at, shard = None, None
    for b in batches:
        out: list[tuple] = []
        for side, key, kind, word, n in zip(*(b.column(c).to_pylist() for c in ("side", "key", "kind", "word", "n"))):
            if (side, key) != at:
                at, shard = (side, key), _Shard(side)
            if kind == 0:
                shard.add(word, n)
                continue
            best, count = None, 0
            for other, k in shard.near(word):
                count += 1
                if best is None or (-k, other) < best:
                    best = (-k, other)
            if count:
                out.append((word, count, best[1], -best[0]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n_near", "form", "form_n"])


def _anchor(side: int, size: Column) -> Column:
    """The outermost code points of a segment of `size` of them, taken from the word."""
    size = F.least(size, F.lit(ANCHOR))
    return F.concat(F.lit(f"{side}"), F.substring(F.col("word"), F.lit(1), size) if side == 0 else F.substring(F.col("word"), -size, size))


def _half(side: int, length: Column) -> Column:
    return F.floor(length / 2).cast("int") if side == 0 else F.ceil(length / 2).cast("int")


def near_words(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, piece: int = PIECE) -> DataFrame:
    """vocabulary(word, n), a written table of distinct words -> word, n_near, form and form_n: how many words are near, and the
    most frequent of them. Words without a near one have no row."""
    spark = vocabulary.sparkSession
    length = F.length("word")
    own = [vocabulary.select(F.lit(side).alias("side"), _anchor(side, _half(side, length)).alias("group"), "word", "n") for side in (0, 1)]
    segments = written(own[0].unionByName(own[1]), "segments")
    # of near words: one shorter, as long, one longer; their segments have one of two lengths, and mostly the same anchor
    around = [
        vocabulary.select(F.lit(side).alias("side"), F.explode(F.array_distinct(F.array(*[_anchor(side, _half(side, F.greatest(length + d, F.lit(least_length)))) for d in (-1, 0, 1)]))).alias("group"), "word", "n")
        for side in (0, 1)
    ]
    # at most HOT_KEYS groups can have more than one piece
    piece = max(piece, -(-segments.count() // HOT_KEYS))
    pieces = F.broadcast(segments.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / piece).cast("long").alias("pieces")).filter("pieces > 1"))
    n = F.coalesce("pieces", F.lit(1))
    held = segments.join(pieces, "group", "left").select("side", F.concat("group", F.lit("/"), F.pmod(F.xxhash64("word"), n).cast("string")).alias("key"), F.lit(0).alias("kind"), "word", "n")
    scanned = around[0].unionByName(around[1]).join(pieces, "group", "left")
    scanned = scanned.select("side", "group", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"), "word", "n")
    scanned = scanned.select("side", F.concat("group", F.lit("/"), F.col("k").cast("string")).alias("key"), F.lit(1).alias("kind"), "word", "n")
    dealt = held.unionByName(scanned).repartition("side", "key").sortWithinPartitions("side", "key", "kind")
    found = written(dealt.mapInArrow(_scan, _FOUND), "near_words")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("form_n").alias("form_n"))
    form = found.join(best.select("word", "form_n"), ["word", "form_n"], "left_semi").groupBy("word").agg(F.min("form").alias("form"))
    out = written(best.join(form, "word"), "forms")
    discard(spark, segments, found)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """forms(word, form), a written table without cycles -> (word, root): each pointer is replaced by that of what it points to."""
    spark = forms.sparkSession
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = salted_join(now, now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", F.col("word"), "left")
        new = written(ahead.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        over = not new.filter("moved").limit(1).count()
        discard(spark, now)
        path, now = new._shared_path, new.select("word", "root")
        now._shared_path = path
        if over:
            return now


def variants(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, misspelt: int | None = None, piece: int = PIECE) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least `least_length` code points (4 at least) that stands at least
    `least_count` times. form: the most frequent near word, if it stands at least `factor` (2 at least) times as often."""
    if least_length < 4 or factor < 2:
        raise ValueError("a segment needs two code points, a chain of forms ever more frequent words")
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = written(words(docs, misspelt, text, id_col).filter((F.length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    near = near_words(vocabulary, least_length, piece)
    whole = vocabulary.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
    taken = F.col("form_n") >= F.col("n") * factor
    whole = written(whole.withColumns({"form": F.when(taken, F.col("form")), "form_n": F.when(taken, F.col("form_n"))}), "whole")
    roots = _roots(whole.filter("form is not null"))
    out = written(whole.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    discard(spark, vocabulary, near, whole, roots)
    return out
