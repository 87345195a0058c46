"""Leader clustering of bit signatures: in order, a file joins the first head within `distance` bits, or
becomes a head.

exact_leaders() runs that rule over one group and suits a few thousand files. leaders() gives the same
answer for many: signatures that are within `distance` bits differ by at most r bits in one of (distance + 1) / (r + 1) bands
(pigeonhole), so an equi-join on bands, probed with r bits flipped, finds every pair of distinct signatures, which is verified by bit count; then heads are
settled in rounds: a file is a head once no file before it within range is undecided or a head, and is
taken once a head before it is within range. Each round is written out, so its lineage is short.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import values


def exact_leaders(files: DataFrame, distance: int, group_col: str) -> DataFrame:
    """files(ordinal, words, group_col) with head (its ordinal) and head_distance, per group of a real column."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal", ignore_index=True)
        words = np.array(frame.words.tolist(), np.int64).view(np.uint64).reshape(len(frame), -1)
        heads, head, far = [], np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for i in range(len(frame)):
            gap = np.bitwise_count(words[heads] ^ words[i]).sum(1) if heads else np.zeros(0)
            near = np.flatnonzero(gap <= distance)
            if len(near):
                head[i], far[i] = frame.ordinal[heads[near[0]]], gap[near[0]]
            else:
                heads.append(i)
                head[i] = frame.ordinal[i]
        return frame.assign(head=head, head_distance=far)

    kinds = ", ".join(f"`{k}` {t}" for k, t in files.dtypes)
    return files.groupBy(group_col).applyInPandas(run, f"{kinds}, head long, head_distance long")


#: signatures that one task explodes
SHARE = 5_000
#: a band should tell so many bits, so that few pairs meet in it; and by how many bits a band may differ to get there
WIDE, RADIUS = 12, 2
#: signatures that may share a band's value before it is divided, how often that is done, and sweeps before all pairs are looked at
HOT, DIVIDED, SWEEPS = 200, 3, 8
#: values that many share, up to which Spark may broadcast them, some 200 bytes each; a level of dividing may have eight times those of the one before
KEYS = 100_000
#: a sweep takes such a part of the signatures, or the values that are shared by many have so many pairs for each; else the sweeps end
WORTH, PAIRS = 0.05, 1_000


def _plan(distance: int, bits: int) -> tuple[int, int]:
    """(bands, radius): signatures within `distance` bits differ by at most `radius` in one of so many bands."""
    for radius in range(RADIUS + 1):
        bands = -(-(distance + 1) // (radius + 1))
        if bits // bands >= WIDE:
            break
    return min(bands, bits), radius


def _value(low: int, high: int) -> Column:
    """Bits low to high of `words`, from its first word's lowest bit on, as a number (62 bits at most)."""
    parts = []
    for k in range(low // 64, (high - 1) // 64 + 1):
        a, b = max(low, 64 * k), min(high, 64 * k + 64)
        part = F.shiftrightunsigned(F.get("words", k), a % 64).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))
        parts.append(F.shiftleft(part, a - low))
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def _cuts(n: int, low: int, high: int) -> list[tuple[int, int]]:
    """[low, high) in n parts, 62 long at most; empty ones are left out."""
    n = max(n, -(-(high - low) // 62))
    cuts = [low + (high - low) * k // n for k in range(n + 1)]
    return [(x, y) for x, y in zip(cuts, cuts[1:]) if y > x]


def _bands(classes: DataFrame, distance: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(plain, probes): each signature under the values of its bands, and under those that are up to the plan's radius away. Two
    signatures within `distance` share a band, and one looks up the other's."""
    bands, radius = _plan(distance, bits)

    def flips(width: int) -> Column:
        masks = [sum(1 << i for i in own) for r in range(radius + 1) for own in itertools.combinations(range(width), r)]
        return F.array(*[F.lit(m).cast("long") for m in masks])

    cuts = _cuts(bands, 0, bits)
    keys = [F.struct(F.lit(k).alias("k"), _value(x, y).alias("v")) for k, (x, y) in enumerate(cuts)]

    def around(k: int, low: int, high: int) -> Column:
        return F.transform(flips(high - low), lambda m: F.struct(F.lit(k).alias("k"), _value(low, high).bitwiseXOR(m).alias("v")))

    near = [around(k, x, y) for k, (x, y) in enumerate(cuts)]
    plain, probes = (classes.select("first", "words", F.explode(x).alias("band")) for x in (F.array(*keys), F.flatten(F.array(*near))))
    return plain.withColumn("k", F.col("band.k")), probes.withColumn("k", F.col("band.k"))


def _divided(rows: DataFrame, level: int, distance: int, bits: int) -> DataFrame:
    """Rows under their key and one more value, of bits outside their band: of more than `distance` parts of those bits, two signatures that are near
    have one alike. Each level cuts them anew."""
    bands, n = _cuts(_plan(distance, bits)[0], 0, bits), distance + 1 + level
    chosen = F.lit(None)
    for k, (x, y) in enumerate(bands):
        first = min(n, max(round(n * x / max(bits - y + x, 1)), int(x > 0)))
        parts = [*(_cuts(first, 0, x) if x else []), *(_cuts(max(n - first, 1), y, bits) if y < bits else [])]
        at = F.array(*[F.struct(F.lit(j).alias("j"), _value(u, v).alias("v")) for j, (u, v) in enumerate(parts)])
        # so few bits that some parts would be empty: near ones need not have one alike
        chosen = F.when(F.col("k") == k, at if len(parts) > distance else F.array(F.struct(F.lit(0).alias("j"), F.lit(0).cast("long").alias("v")))).otherwise(chosen)
    return rows.withColumn("part", F.explode(chosen)).withColumn("band", F.struct(F.col("band").alias("of"), "part")).drop("part")


def _big(rows: DataFrame) -> DataFrame:
    """To be joined by shuffle and sort. Spark takes rows that are exploded for no larger than what they come from, and a written table for its compressed
    size, so it would collect either in the driver to broadcast it."""
    return rows.hint("merge")


def _dealt(rows: DataFrame, share: int = SHARE) -> DataFrame:
    """A written table over as many tasks as it has times `share` rows: its few bytes make one task, but each row is exploded."""
    return rows.repartition(-(-rows.count() // share) or 1)


def _met(plain: DataFrame, probes: DataFrame, distance: int, bits: int, hot: int, save, level: int = 0) -> DataFrame:
    """(first, other, gap) of signatures that share a key and are within `distance`; a key of more than `hot` signatures is divided."""
    if save is not None and level < DIVIDED:
        large = save(plain.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select("band"))
        if n := large.count():
            large = large if n <= KEYS else _big(large)
            inner = _met(*(_divided(_dealt(save(side.join(large, "band", "left_semi")), SHARE * 8), level, distance, bits) for side in (plain, probes)), distance, bits, hot, save, level + 1)
            return _met(plain.join(large, "band", "left_anti"), probes, distance, bits, hot, None).unionByName(inner).distinct()
    gap = values.hamming("words", "theirs")
    both = plain.join(_big(probes.select(F.col("first").alias("other"), F.col("words").alias("theirs"), "band")), "band")
    return both.filter("first <> other").select("first", "other", gap.alias("gap")).filter(F.col("gap") <= distance).distinct()


def _classes(files: DataFrame) -> DataFrame:
    return files.groupBy("words").agg(F.min("ordinal").alias("first"))


def near_classes(classes: DataFrame, distance: int, bits: int, save=None, hot: int = HOT) -> DataFrame:
    """(first, other, gap), both ways round, of distinct signatures(first, words) within `distance` bits; words must all have
    `bits` bits. One side looks up each band as it is, the other also with up to the plan's radius of its bits flipped, so bands can be wide and few other
    signatures share one. With save(df) -> df, which writes a table, a value that many share is divided by other bits."""
    return _met(*_bands(classes, distance, bits), distance, bits, hot, save)


def near_pairs(files: DataFrame, distance: int, bits: int, save=None) -> DataFrame:
    """(a, b, gap) of files with a before b and at most `distance` bits between them. Equal signatures meet once, by their first ordinals; but
    the result has all pairs of their files."""
    classes = _classes(files)
    same = classes.select("first", F.col("first").alias("other"), F.lit(0).alias("gap"))
    members = files.join(_big(classes), "words").select("first", "ordinal")
    found = near_classes(classes, distance, bits, save).unionByName(same)
    a, b = members.select("first", F.col("ordinal").alias("a")), members.select(F.col("first").alias("other"), F.col("ordinal").alias("b"))
    pairs = found.join(_big(a), "first").join(_big(b), "other")
    return pairs.filter("a < b").select("a", "b", "gap")


def leaders(files: DataFrame, distance: int, bits: int, save, hot: int = HOT, sweeps: int = SWEEPS) -> DataFrame:
    """files with head and head_distance, as exact_leaders() over one group. save(df) -> df writes a table.

    Files with equal signatures take the head of the first of them, so only distinct signatures are looked at. While many share
    a band's value, those that are the first in all their bands are heads, as nothing before them can be near; what is
    near to them is taken, and goes. Pairs are made of what is left."""
    classes = save(_classes(files))
    left, heads, before = classes, classes.limit(0), None
    for _ in range(sweeps):
        plain, probes = _bands(_dealt(left), distance, bits)
        pairs = plain.groupBy("band").count().filter(F.col("count") > hot).agg(F.sum(F.col("count") * F.col("count"))).first()[0]
        n = left.count()
        # a sweep that took few is not worth another, unless the pairs would be too many
        if not pairs or (before and n > before * (1 - WORTH) and pairs < PAIRS * n):
            break
        before = n
        least = plain.groupBy("band").agg(F.min("first").alias("least"))
        sure = probes.select("first", "band").join(_big(least), "band").groupBy("first").agg(F.min("least").alias("least")).filter("least = first").select("first")
        new = save(left.join(_big(sure), "first", "left_semi").select("words", "first"))
        taken = _met(_bands(new, distance, bits)[0], probes, distance, bits, hot, save).select(F.col("other").alias("first"))
        heads = heads.unionByName(new)
        left = save(left.join(_big(new.select("first").unionByName(taken).distinct()), "first", "left_anti").select("words", "first"))
    pairs = save(near_classes(_dealt(left), distance, bits, save, hot).filter("first < other"))
    state = save(left.select(F.col("first").alias("ordinal")).withColumn("is_head", F.lit(None).cast("boolean")))
    while state.filter("is_head is null").limit(1).count():
        before = pairs.join(_big(state.select(F.col("ordinal").alias("first"), F.col("is_head").alias("a_head"))), "first")
        seen = before.groupBy(F.col("other").alias("ordinal")).agg(F.max(F.coalesce("a_head", F.lit(False))).alias("has_head"), F.max(F.col("a_head").isNull()).alias("has_open"))
        now = state.join(_big(seen), "ordinal", "left")
        decided = F.when(F.col("is_head").isNotNull(), F.col("is_head")).when(F.col("has_head"), F.lit(False)).when(~F.coalesce("has_open", F.lit(False)), F.lit(True))
        state = save(now.select("ordinal", decided.alias("is_head")))
    late = left.join(_big(state.filter("is_head").select(F.col("ordinal").alias("first"))), "first", "left_semi").select("words", "first")
    heads = save(heads.unionByName(late))
    # a signature with a head before it within range is no head itself
    found = _met(_bands(heads, distance, bits)[0], _bands(_dealt(classes), distance, bits)[1], distance, bits, hot, save).filter("first < other")
    first = found.groupBy(F.col("other").alias("first")).agg(F.min(F.struct("first", "gap")).alias("m"))
    own = classes.join(_big(first), "first", "left").select("words", F.coalesce("m.first", "first").alias("head"), F.coalesce("m.gap", F.lit(0)).cast("long").alias("head_distance"))
    out = files.join(_big(own), "words", "left").withColumns({"head": F.coalesce("head", "ordinal"), "head_distance": F.coalesce("head_distance", F.lit(0).cast("long"))})
    return out.select(*files.columns, "head", "head_distance")


def nearest_heads(files: DataFrame, heads: DataFrame, distance: int, bits: int, save, hot: int = HOT) -> DataFrame:
    """ordinal, head and head_distance of the files that a given head(ordinal, words) is near to: the first such head."""
    classes = _classes(files)
    # the first and other of a pair are numbers of two tables, so equal ones are told apart by their sign
    own = _bands(classes.select("words", (-1 - F.col("first")).alias("first")), distance, bits)[1]
    found = _met(_bands(heads.select("words", F.col("ordinal").alias("first")), distance, bits)[0], own, distance, bits, hot, save)
    first = found.groupBy((-1 - F.col("other")).alias("first")).agg(F.min(F.struct(F.col("first").alias("head"), "gap")).alias("m"))
    near = classes.join(_big(first), "first").select("words", "m.head", F.col("m.gap").cast("long").alias("head_distance"))
    return files.select("ordinal", "words").join(_big(near), "words").select("ordinal", "head", "head_distance")


def groups(clustered: DataFrame, bits: int) -> DataFrame:
    """Per head of more than one file: n_files and similarity in percent, by the file farthest from it."""
    g = clustered.groupBy("head").agg(F.count(F.lit(1)).alias("n_files"), F.max("head_distance").alias("farthest")).filter("n_files > 1")
    return g.withColumn("similarity", values.similarity(F.col("farthest"), F.lit(bits)))


def at_least(grouped: DataFrame, percent: int) -> DataFrame:
    return grouped.filter(F.col("similarity") >= percent)
