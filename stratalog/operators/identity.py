"""Groups by embedded identity: duplicates (same version) and versions (several)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import versions
from stratalog.operators import ranges

SEPARATOR = "\u001f"


@dataclass(frozen=True)
class GroupSpec:
    """What makes a group: its key, and whether different versions are what counts."""

    keys: tuple[str, ...]
    by_version: bool = False


DUPLICATES = GroupSpec(("guid", "author", "version"))
VERSIONS = GroupSpec(("guid", "author"), by_version=True)


def grouped(files: DataFrame, spec: GroupSpec) -> DataFrame:
    """Files of groups with more than one file, or more than one raw version, with group_id, and for versions
    latest_version and rank (highest version, latest mtime, smallest path first)."""
    measure = F.count_distinct(F.coalesce("version", F.lit(""))) if spec.by_version else F.count(F.lit(1))
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in spec.keys]
    own = files.withColumn("group_id", F.concat_ws(SEPARATOR, *keys))
    many = own.groupBy("group_id").agg(measure.alias("_n")).filter("_n > 1").select("group_id")
    out = own.join(many, "group_id", "left_semi")
    if not spec.by_version:
        return out
    order = Window.partitionBy("group_id").orderBy(F.desc("version_key"), F.desc("mtime"), "file_path")
    out = versions.with_key(out, "version", ["group_id"]).withColumn("rank", F.row_number().over(order))
    return out.withColumn("latest_version", F.first("version").over(order)).drop("version_key")


def listed(groups: DataFrame, locale: str | None = None) -> DataFrame:
    """Groups by group_id, in byte order or in that of a locale (UNICODE, en, de, ... as Spark's collations have it)."""
    return groups.orderBy("group_id") if locale is None else groups.orderBy(F.collate("group_id", locale), "group_id")


def keep_duplicates(files: DataFrame, newest: bool = True, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """selected for all but the newest (or oldest) by mtime; equal times keep the order of paths. With save(df) -> df, which writes a table, a
    group of any size is dealt over ranges; else one task has a group."""
    if save is not None:
        out = ranges.running_sum(files, ["group_id"], [F.desc("mtime"), F.col("file_path")], F.lit(1).cast("long"), save, "_place", "_all")
        return out.withColumn("selected", F.col("_place") != (F.lit(1) if newest else F.col("_all"))).drop("_place", "_all")
    order = Window.partitionBy("group_id").orderBy(F.desc("mtime"), "file_path")
    place = F.row_number().over(order)
    n = F.count(F.lit(1)).over(Window.partitionBy("group_id"))
    return files.withColumn("selected", place != (F.lit(1) if newest else n))


def keep_versions(files: DataFrame, newest: bool = True) -> DataFrame:
    """selected for all files but those of the highest (or lowest) version."""
    keyed = versions.with_key(files, "version", ["group_id"])
    w = Window.partitionBy("group_id")
    best = (F.max if newest else F.min)("version_key").over(w)
    return keyed.withColumn("selected", F.col("version_key") != best).drop("version_key")


def keep_by_policy(files: DataFrame, policy: str, group_cols: list[str]) -> DataFrame:
    """rank and selected of images by policy: largestResolution, largestFile, newest, oldest; others as the first."""
    area = F.col("width").cast("long") * F.col("height")
    orders = {
        "largestResolution": [area.desc(), F.desc("file_size")],
        "largestFile": [F.desc("file_size")],
        "newest": [F.desc("mtime")],
        "oldest": [F.asc("mtime")],
    }
    order = orders.get(policy, orders["largestResolution"])
    rank = F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order, "file_path"))
    return files.withColumn("rank", rank).withColumn("selected", F.col("rank") > 1)


#: The words of a group's header.
FILES, KEPT, NEWEST, NONE, UNKNOWN = "个文件", "保留：", "最新", "（未指定）", "unknown"


def headers(files: DataFrame, by_version: bool = False) -> DataFrame:
    """group_id and title: author, version (the latest, of versions), number of files and the name of the first file that isn't
    selected, by path or, of versions, by `rank` as grouped() gives it. One aggregation that combines on the map side."""
    filled = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNKNOWN))
    name = F.substring_index(F.translate("file_path", "\\", "/"), "/", -1)
    own = F.concat_ws(" · ", filled("version"), name) if by_version else name
    kept = F.min_by(F.when(~F.col("selected"), own), F.when(~F.col("selected"), F.col("rank" if by_version else "file_path")))
    version = "latest_version" if by_version else "version"
    g = files.groupBy("group_id").agg(F.min_by(filled("author"), "file_path").alias("a"), F.min_by(filled(version), "file_path").alias("v"), F.count(F.lit(1)).alias("n"), kept.alias("k"))
    shown = F.concat(F.lit(f"{NEWEST} "), F.col("v")) if by_version else F.col("v")
    title = F.concat_ws(" · ", F.col("a"), shown, F.concat(F.col("n").cast("string"), F.lit(f" {FILES}")), F.concat(F.lit(KEPT), F.coalesce("k", F.lit(NONE))))
    return g.select("group_id", title.alias("title"))
