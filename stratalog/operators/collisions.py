"""Batch collision resolution.

Requests are served in order. A target is free if neither disk nor an earlier request has it (any case);
otherwise the smallest i from 1 on gives ` (i)` before the suffix (at the end, where names are said to have none). Only names that differ by such numbers
can meet, so requests are dealt by folder, suffix and the stem without its numbers: a family. Requests without a target
take no part in that.

Families of at most HOT requests are sorted by their order and streamed, each by one task that holds the names it
has taken. Larger ones are resolved by all tasks together, level by level of nested numbers. At each level a
target goes to its first request, unless disk or the level before has it; the others, in order, want the numbers below it.
Numbers only grow, so the k-th of them gets the k-th number that isn't skipped, and skipped are the numbers that disk or a request
for just that name has taken before the turn comes to it: k-th places, and how many stand before them, are running counts over
ranges. Only whether a number i is skipped whose name is asked for after the first, but before the i-th of the others depends
on what was skipped below it; those alone pass a target's task one after another, as numbers.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import names, paths
from stratalog.operators.ranges import running_sum
from stratalog.operators.streams import numbered
from stratalog.scratch import save

_SUFFIX = re.compile(r"^(.+)(\.[^.]*)$", re.S)


def resolved(target: str, taken: set[str], next_free: dict[str, int], suffixed: bool = True) -> tuple[str, bool]:
    """The name that a request gets, and whether it isn't the one it asked for. taken: lower-case paths."""
    if target.lower() not in taken:
        taken.add(target.lower())
        return target, False
    folder, _, name = target.rpartition("/")
    m = _SUFFIX.match(name) if suffixed else None
    stem, suffix = (m[1], m[2]) if m else (name, "")
    lead = f"{folder}/" if "/" in target else ""
    i = next_free.get(target.lower(), 1)
    while (found := f"{lead}{stem} ({i}){suffix}").lower() in taken:
        i += 1
    next_free[target.lower()] = i + 1
    taken.add(found.lower())
    return found, True


#: requests of a family that one task serves
HOT = 100_000
#: a number that resolution itself can have given, before the suffix; larger ones are part of a name
_NUMBER = r" \([1-9][0-9]{0,17}\)"


def resolve(requests: DataFrame, existing: DataFrame | None = None, target_col: str = "target", order_col: str = "ordinal", hot: int = HOT, suffixed: bool = True) -> DataFrame:
    """requests with new_path and conflict. existing(path): what is on disk when the plan is made. Not suffixed: a dot in a name begins no
    suffix, so numbers come at its end."""
    t = paths.slashed(target_col)
    columns = requests.columns
    none = requests.filter(t.isNull()).withColumns({"new_path": F.lit(None).cast("string"), "conflict": F.lit(False)})
    own = requests.withColumn("_target", t).filter("_target is not null").withColumn("_family", _family("_target", suffixed))
    old = None
    if existing is not None:
        p = paths.slashed("path")
        old = existing.filter(p.isNotNull()).select(p.alias("_target"), _family(p, suffixed).alias("_family"))
        # names that no request can meet stay out of the shuffle's sort
        old = old.join(own.select("_family").distinct(), "_family", "left_semi")
    # at most a family for each `hot` requests
    large = save(own.groupBy("_family").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select("_family"))
    if large.limit(1).count():
        large = F.broadcast(large)
        many = _together(own.join(large, "_family", "left_semi"), old.join(large, "_family", "left_semi") if old is not None else None, columns, order_col, suffixed)
        own, old = own.join(large, "_family", "left_anti"), old.join(large, "_family", "left_anti") if old is not None else None
        return _streamed(own, old, columns, order_col, suffixed).unionByName(many).unionByName(none)
    return _streamed(own, old, columns, order_col, suffixed).unionByName(none)


def _parts(name: Column, suffixed: bool) -> tuple[Column, Column]:
    """What stands before a number, and after it."""
    return (names.stem(name), F.coalesce(names.suffix(name), F.lit(""))) if suffixed else (name, F.lit(""))


def _family(path: Column | str, suffixed: bool) -> Column:
    stem, suffix = _parts(paths.basename(path), suffixed)
    return F.lower(F.concat_ws("/", paths.parent(path), names.family(stem), suffix))


def _streamed(own: DataFrame, old: DataFrame | None, columns: list[str], order_col: str, suffixed: bool) -> DataFrame:
    """Each family by one task."""
    own = own.withColumn("_kind", F.lit(1))
    if old is not None:
        own = own.unionByName(old.withColumn("_kind", F.lit(0)), allowMissingColumns=True)

    def run(batches):
        at, taken, next_free = None, set(), {}
        for b in batches:
            found, conflict, keep = [], [], []
            for family_, kind, target in zip(*(b.column(c).to_pylist() for c in ("_family", "_kind", "_target"))):
                if family_ != at:
                    at, taken, next_free = family_, set(), {}
                if kind == 0:
                    taken.add(target.lower())
                    keep.append(False)
                    continue
                new, other = resolved(target, taken, next_free, suffixed)
                keep.append(True), found.append(new), conflict.append(other)
            rows = b.filter(pa.array(keep, pa.bool_())).select(columns)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string()), pa.array(conflict, pa.bool_())], [*columns, "new_path", "conflict"])

    schema = own.select(*columns, F.lit("").alias("new_path"), F.lit(True).alias("conflict")).schema
    for f in schema:
        f.nullable = True
    dealt = own.repartition("_family").sortWithinPartitions("_family", "_kind", order_col, "_target")
    return dealt.mapInArrow(run, schema)


def _named(df: DataFrame, suffixed: bool) -> DataFrame:
    """_target in lower case as _key; where it ends in a number, that as _number and the target below which it lies as _above."""
    name = paths.basename("_target")
    stem, suffix = _parts(name, suffixed)
    trail = F.regexp_extract(stem, f"(?s)^.+?((?:{_NUMBER})+)$", 1)
    lead = F.substring(F.col("_target"), F.lit(1), F.length("_target") - F.length(name))
    number = F.when(trail != "", F.regexp_extract(stem, r"\(([0-9]+)\)$", 1).cast("long"))
    above = F.when(trail != "", F.lower(F.concat(lead, F.regexp_replace(stem, f"{_NUMBER}$", ""), suffix)))
    depth = (F.length(trail) - F.length(F.replace(trail, F.lit(" ("), F.lit("")))) / 2
    parts = {"_key": F.lower("_target"), "_number": number, "_above": above, "_depth": depth.cast("int"), "_lead": F.concat(lead, stem), "_suffix": suffix}
    return df.withColumns(parts)


def _skips(frames):
    """Of numbers that may be skipped, sorted by _key and _number, those that are: _r of the others come before the request for the name itself,
    _sure are skipped below in any case."""
    at, more = None, 0
    for f in frames:
        keep = []
        for key, number, r, sure in zip(f._key, f._number, f._r, f._sure):
            if key != at:
                at, more = key, 0
            skipped = sure + more < number - r
            more += skipped
            keep.append(bool(skipped))
        yield f[keep][["_key", "_number"]]


def _together(own: DataFrame, old: DataFrame | None, columns: list[str], order_col: str, suffixed: bool) -> DataFrame:
    """Large families, by all tasks."""
    spark = own.sparkSession
    asked = save(_named(numbered(own, [order_col, "_target"], save, 0, "_at"), suffixed))
    narrow = asked.select("_at", "_key", "_above", "_number", "_depth")
    disk = old.select("_target").distinct() if old is not None else spark.createDataFrame([], "_target string")
    disk = save(_named(disk, suffixed).select("_key", "_above", "_number").distinct())
    beaten = spark.createDataFrame([], "_key string")
    results = []
    for depth in sorted(r[0] for r in narrow.select("_depth").distinct().collect()):
        here = narrow.filter(F.col("_depth") == depth)
        taken = disk.select("_key").unionByName(beaten).distinct().withColumn("_taken", F.lit(True))
        first = here.groupBy("_key").agg(F.min("_at").alias("_first")).join(taken, "_key", "left").filter("_taken is null").select(F.col("_first").alias("_at"))
        results.append(here.join(first, "_at", "left_semi").select("_at", F.lit(None).cast("long").alias("_i")))
        others = save(here.join(first, "_at", "left_anti").select("_at", "_key"))
        # names below these targets that disk has or requests are for, and the first of those
        wanted = narrow.filter(F.col("_depth") == depth + 1).select(F.col("_above").alias("_key"), "_number", F.col("_at").alias("_first"), F.col("_key").alias("_name"))
        below = wanted.unionByName(disk.filter("_above is not null").select(F.col("_above").alias("_key"), "_number", F.lit(-1).cast("long").alias("_first"), F.col("_key").alias("_name")))
        below = save(below.groupBy("_key", "_number", "_name").agg(F.min("_first").alias("_first")).join(others.select("_key").distinct(), "_key", "left_semi"))
        both = others.select("_key", "_at", F.lit(None).cast("long").alias("_number")).unionByName(below.select("_key", F.col("_first").alias("_at"), "_number"))
        # the others' places, and for a name how many of them come before its first request
        placed = save(running_sum(both, ["_key"], ["_at", "_number"], F.col("_number").isNull().cast("long"), save, "_r"))
        own_place = placed.filter("_number is null").select("_key", "_at", F.col("_r").alias("_k"))
        may = placed.filter("_number is not null and _r < _number")
        if not may.limit(1).count():
            got = own_place.withColumn("_i", F.col("_k"))
        else:
            counted = running_sum(may, ["_key"], ["_number"], (F.col("_r") == 0).cast("long"), save, "_sure")
            unsure = counted.filter("_r > 0").select("_key", "_number", "_r", "_sure")
            found = unsure.repartition("_key").sortWithinPartitions("_key", "_number").mapInPandas(_skips, "_key string, _number long")
            skipped = save(may.filter("_r = 0").select("_key", "_number").unionByName(found))
            # the j-th skipped number c stands before the places from c - j + 1 on
            turns = running_sum(skipped, ["_key"], ["_number"], F.lit(1).cast("long"), save, "_j").select("_key", (F.col("_number") - F.col("_j") + 1).alias("_k"), F.lit(1).cast("long").alias("_skip"), F.lit(-1).cast("long").alias("_at"))
            got = running_sum(own_place.withColumn("_skip", F.lit(0).cast("long")).unionByName(turns, allowMissingColumns=True), ["_key"], ["_k", "_at"], F.col("_skip"), save, "_more")
            got = got.filter("_skip = 0").withColumn("_i", F.col("_k") + F.col("_more"))
        got = save(got.select("_key", "_at", "_i"))
        results.append(got.select("_at", "_i"))
        beaten = below.join(got.select("_key", F.col("_i").alias("_number")), ["_key", "_number"], "left_semi").select(F.col("_name").alias("_key"))
    out = asked.join(functools.reduce(DataFrame.unionByName, results), "_at")
    new = F.when(F.col("_i").isNull(), F.col("_target")).otherwise(F.concat("_lead", F.lit(" ("), F.col("_i").cast("string"), F.lit(")"), "_suffix"))
    return out.select(*columns, new.alias("new_path"), F.col("_i").isNotNull().alias("conflict"))
