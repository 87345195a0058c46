"""Paths as trees: root normalisation, longest root, subtrees, empty directories. Equi-joins on exploded
ancestors throughout, never a prefix test of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import paths


def normalize_roots(roots: DataFrame, path_col: str = "path", ok_col: str | None = None) -> DataFrame:
    """Each root (path, ordinal) with status: kept, inaccessible, duplicate (any case), covered (by a kept ancestor)."""
    own = roots.withColumn("_key", paths.key(path_col)).withColumn("_ok", F.coalesce(F.col(ok_col), F.lit(False)) if ok_col else F.lit(True))
    first = F.row_number().over(Window.partitionBy("_key", "_ok").orderBy("ordinal"))
    own = own.withColumn("_first", first == 1)
    tops = own.filter("_ok and _first").select("_key")
    above = tops.select("_key", F.explode(paths.ancestors("_key")).alias("_top"))
    covered = above.join(tops.withColumnRenamed("_key", "_top"), "_top", "left_semi").select("_key").distinct().withColumn("_covered", F.lit(True))
    out = own.join(covered, "_key", "left")
    status = F.when(~F.col("_ok"), "inaccessible").when(~F.col("_first"), "duplicate").when(F.col("_covered"), "covered").otherwise("kept")
    return out.withColumn("status", status).drop("_key", "_ok", "_first", "_covered")


def longest_root(files: DataFrame, roots: DataFrame, path_col: str = "path", root_col: str = "root") -> DataFrame:
    """files with the longest of roots that holds each, and the folders between (relative); exact case wins over
    any case; null where none does."""
    own = files.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in files.columns else files
    # one row per file and ancestor; the file's own columns don't travel with them
    up = own.select(F.col(path_col).alias("_path")).distinct().select("_path", F.explode(paths.ancestors("_path")).alias("_top")).withColumn("_key", F.lower("_top"))
    tops = roots.select(F.col(root_col).alias("root")).distinct().withColumn("_key", paths.key("root"))
    hit = up.join(tops, "_key").withColumn("_exact", paths.slashed("root") == F.col("_top"))
    best = F.max_by("root", F.struct(F.length("_key"), F.col("_exact").cast("int"), F.col("root")))
    found = hit.groupBy("_path").agg(best.alias("root"))
    out = own.drop("_id").join(found, F.col(path_col) == F.col("_path"), "left").drop("_path")
    return out.withColumn("relative", paths.relative_to(path_col, "root"))


def select_below(items: DataFrame, selected: DataFrame, path_col: str = "path") -> DataFrame:
    """items that are one of the selected paths or lie below one, any case."""
    own = items.select(F.col(path_col).alias("_path")).distinct().select("_path", F.explode(paths.ancestors("_path", with_self=True)).alias("_top"))
    tops = selected.select(paths.key(path_col).alias("_key")).distinct()
    hit = own.withColumn("_key", F.lower("_top")).join(tops, "_key", "left_semi").select("_path").distinct()
    return items.join(hit, items[path_col] == hit["_path"], "left_semi")


def empty_dirs(tree: DataFrame, include_roots: bool = False) -> DataFrame:
    """Directories (path, depth) of tree (path, is_dir, readable, root) below which there is no file at all.
    Unreadable directories and links count as files. Deepest come first when sorted by depth."""
    p = paths.slashed("path")
    own = tree.withColumn("_p", p).withColumn("_solid", ~F.col("is_dir") | ~F.coalesce(F.col("readable"), F.lit(True)))
    used = own.filter("_solid").select(F.explode(paths.ancestors("_p", with_self=True)).alias("_p")).distinct()
    out = own.filter("is_dir").join(used, "_p", "left_anti")
    if not include_roots:
        out = out.filter(F.col("_p") != paths.slashed("root"))
    return out.dropDuplicates(["_p"]).select(F.col("_p").alias("path"), paths.depth("_p").alias("depth"))


def longest_first(roots: DataFrame) -> DataFrame:
    """Roots in the order in which they are tried: the longest first, ties by path."""
    return roots.orderBy(F.desc(F.length("path")), "path")


def deepest_first(dirs: DataFrame) -> DataFrame:
    """Empty directories in the order in which they can be deleted."""
    return dirs.orderBy(F.desc("depth"), "path")
