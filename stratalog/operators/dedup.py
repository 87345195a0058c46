"""Exact duplicates: grouping by content hash, history, which copies to keep, totals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import paths
from stratalog.operators import ranges


PREFIX = 4


@dataclass(frozen=True)
class DedupConfig:
    keep: str = "oldest"  # `newest`, anything else is oldest
    time_col: str = "ctime"
    use_history: bool = False
    history_only: bool = False  # pairs of a current file with history alone count
    include_history: bool = False  # groups of history alone count too
    exclude_self_history: bool = False


def same_size(files: DataFrame, size_col: str = "size") -> DataFrame:
    """Files whose size occurs more than once: the cheap test before hashing. The counts are one small
    aggregation that is joined back, so a very common size is split by skew handling, unlike in a window."""
    common = files.groupBy(size_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(size_col)
    return files.join(common, size_col, "left_semi")


def with_history(current: DataFrame, history: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """Both sides with from_history; of history only rows with status `active`."""
    old = history.filter("status = 'active'").drop("status")
    if config.exclude_self_history:
        own = current.select("hash", paths.key("path").alias("_p"))
        old = old.withColumn("_p", paths.key("path")).join(own, ["hash", "_p"], "left_anti").drop("_p")
    return current.withColumn("from_history", F.lit(False)).unionByName(old.withColumn("from_history", F.lit(True)), allowMissingColumns=True)


def reported(n_current: Column, n_history: Column, config: DedupConfig) -> Column:
    """Whether a group of so many current and history files is reported."""
    if config.use_history and config.history_only:
        return (n_current > 0) & (n_history > 0)
    alone = (n_history > 1) & F.lit(config.include_history)
    crossed = (n_history > 0) & (n_current >= 1)
    return (n_current + n_history >= 2) & ((n_current > 1) | crossed | alone)


def duplicates(files: DataFrame, config: DedupConfig = DedupConfig(), save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Files (hash, path, from_history, time_col, ...) of reported groups with group_id `G00001`, ..., n_files,
    rank (1 is kept where history has no say) and selected (to be moved). Ties go by path. With save(df) -> df, which writes a table, a group
    of any size is ranked over ranges; else one task has a group."""
    counts = files.groupBy("hash").agg(F.count_if(~F.col("from_history")).alias("n_current"), F.count_if("from_history").alias("n_history"))
    groups = counts.filter(reported(F.col("n_current"), F.col("n_history"), config)).select("hash", "n_current", "n_history")
    return ranked(numbered(files.join(groups, "hash")), config, save)


def numbered(files: DataFrame) -> DataFrame:
    """group_id by the order of the hashes. Distinct hashes are counted by their first PREFIX characters (at most
    16 ** PREFIX of them), which fixes where each prefix starts; within it they are ranked, so no task sees all."""
    ids = files.select("hash").distinct().withColumn("_lead", F.substring("hash", 1, PREFIX))
    counts = ids.groupBy("_lead").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_lead", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_lead").orderBy("hash"))
    ids = ids.join(starts, "_lead").withColumn("group_id", F.format_string("G%05d", F.col("_start") + place)).select("hash", "group_id")
    return files.join(ids, "hash")


def ranked(files: DataFrame, config: DedupConfig, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    newest = config.keep == "newest"
    t = F.col(config.time_col)
    order = [t.desc() if newest else t.asc(), F.col("path").asc()]
    history = F.lit(config.use_history) & (F.col("n_history") > 0)
    if save is None:
        out = files.withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy(*order)))
    else:
        out = ranges.running_sum(files, ["hash"], order, F.lit(1).cast("long"), save, "rank").withColumn("rank", F.col("rank").cast("int"))
    out = out.withColumn("n_files", F.col("n_current") + F.col("n_history"))
    return out.withColumn("selected", F.when(history, ~F.col("from_history")).otherwise(F.col("rank") > 1)).drop("n_current", "n_history")


def keep_only(files: DataFrame, path: str, group_col: str = "group_id") -> DataFrame:
    """In groups that hold `path`, everything else is selected."""
    holds = F.max(F.col("path") == path).over(Window.partitionBy(group_col))
    return files.withColumn("selected", F.when(holds, F.col("path") != path).otherwise(F.col("selected")))


def select_folder(files: DataFrame, folder: str) -> DataFrame:
    """Also selects what lies below folder (case as given); clears nothing."""
    return files.withColumn("selected", F.col("selected") | F.col("path").startswith(folder.rstrip("/") + "/"))


def search_groups(files: DataFrame, text: str, group_col: str = "group_id") -> DataFrame:
    """The files whose path contains text (trimmed, any case), so groups without one vanish."""
    t = text.strip().lower()
    return files.filter(F.lower("path").contains(t)) if t else files


def without(files: DataFrame, moved: DataFrame, group_col: str = "group_id", fold_case: bool = False, having: Column | None = None) -> DataFrame:
    """files without the paths of moved; then only groups of more than one file, or that meet `having`."""
    key = (lambda c: F.lower(c)) if fold_case else (lambda c: F.col(c))
    gone = moved.select(key("path").alias("_p")).distinct()
    left = files.withColumn("_p", key("path")).join(gone, "_p", "left_anti").drop("_p")
    keep = left.groupBy(group_col).agg((having if having is not None else F.count(F.lit(1)) > 1).alias("_ok")).filter("_ok").select(group_col)
    return left.join(keep, group_col, "left_semi")


def selection_totals(files: DataFrame, group_col: str = "group_id") -> DataFrame:
    return files.agg(F.countDistinct(group_col).alias("n_groups"), F.count(F.lit(1)).alias("n_files"), F.count_if("selected").alias("n_selected"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("size"))), F.lit(0)).alias("selected_bytes"))
