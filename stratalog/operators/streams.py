"""Running values, rings and upserts over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators import ranges


def rate_slots(events: DataFrame, interval: Column | int, time_col: str, order: list[str], by: list[str] | None = None, save=None) -> DataFrame:
    """slot: max(slot before + interval, own time), in closed form. Without `by` (what is scheduled apart, such as an account) all events
    are one sequence; with save(df) -> df, which writes a table, and a fixed interval it is dealt over ranges, else one task sees it."""
    if save is not None and not by and isinstance(interval, int):
        return ranges.rate_slots(events, interval, time_col, order, save)
    iv = F.lit(interval) if isinstance(interval, int) else interval
    keys = by or []
    w = Window.partitionBy(*keys).orderBy(*order)
    i = F.row_number().over(w) - 1
    out = events.withColumn("_i", i).withColumn("_base", F.col(time_col) - F.col("_i") * iv)
    slot = F.col("_i") * iv + F.max("_base").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("slot", F.when(iv <= 0, F.col(time_col)).otherwise(slot)).drop("_i", "_base")


def progress(events: DataFrame, by: str, order: list[str], save=None) -> DataFrame:
    """processed, total and percent of each event within its task. With save(df) -> df a task of any size is dealt over ranges."""
    if save is not None:
        out = ranges.running_sum(events, [by], order, F.lit(1).cast("long"), save, "processed", "total")
    else:
        total = F.count(F.lit(1)).over(Window.partitionBy(by))
        out = events.withColumn("processed", F.row_number().over(Window.partitionBy(by).orderBy(*order))).withColumn("total", total)
    return out.withColumn("percent", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("processed") / F.col("total") * 100))


def ring(events: DataFrame, cap: int, order_col: str = "seq", most: int = 500_000) -> DataFrame:
    """The newest min(cap, most) events (3000 where cap isn't positive), by a top-k, which sorts no table."""
    n = min(cap if cap > 0 else 3000, most)
    return events.orderBy(F.desc(order_col)).limit(n)


def upsert(old: DataFrame, new: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per key: the latest of both, incoming before old where they are as late."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*[c for c in both.columns if c not in ("_new",)])
    latest = both.groupBy(key).agg(F.max_by(row, F.struct(order_col, "_new")).alias("_row"))
    return latest.select("_row.*")


def last_per_key(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    row = F.struct(*events.columns)
    return events.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def page(df: DataFrame, order: list, offset: int, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def first_per_group(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def search(df: DataFrame, text: str, columns: list[str], extra: Column | None = None) -> DataFrame:
    """Rows whose columns, joined by blanks, contain text (trimmed, any case)."""
    t = text.strip().lower()
    out = df.filter(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])).contains(t)) if t else df
    return out.filter(extra) if extra is not None else out


def toggle_page(selected: DataFrame, paged: DataFrame, key: str, checked: bool) -> DataFrame:
    """The selected keys with, or without, those of the page on show; other pages stay as they are."""
    own, shown = selected.select(key).distinct(), paged.select(key).distinct()
    return own.unionByName(shown).distinct() if checked else own.join(shown, key, "left_anti")


def page_state(selected: DataFrame, paged: DataFrame, key: str) -> DataFrame:
    """all_selected and some_selected (but not all) of a page."""
    marked = paged.select(key).join(selected.select(key).distinct().withColumn("_s", F.lit(True)), key, "left")
    n, k = F.count(F.lit(1)), F.count_if(F.col("_s"))
    return marked.agg(((n > 0) & (k == n)).alias("all_selected"), ((k > 0) & (k < n)).alias("some_selected"))


def flushes(events: DataFrame, by: str, order: list[str], n: int = 30, seconds: int | None = None, time_col: str = "t") -> DataFrame:
    """flush: the number, from 0 within `by`, of the emission that an event goes out with: every n events, or with `seconds`
    also where the event's time falls into a later interval than that of the one before."""
    w = Window.partitionBy(by).orderBy(*order)
    if seconds is None:
        return events.withColumn("flush", F.floor((F.row_number().over(w) - 1) / n).cast("long"))
    slot = F.floor(F.col(time_col) / seconds)
    inside = F.row_number().over(Window.partitionBy(by, "_slot").orderBy(*order))
    part = events.withColumn("_slot", slot).withColumn("_part", F.floor((inside - 1) / n))
    return part.withColumn("flush", (F.dense_rank().over(Window.partitionBy(by).orderBy("_slot", "_part")) - 1).cast("long")).drop("_slot", "_part")


def numbered(df: DataFrame, order: list[str], save, first: int = 1, name: str = "number") -> DataFrame:
    """df with its place in the order, from `first` on. save(df) -> df writes Parquet: sorted ranges become files, whose rows are
    counted; a row's number is where its file begins and its place there, so no task sees all rows."""
    kept = save(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = kept.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = at.groupBy("_file").agg(F.max("_row").alias("_last"))  # one row a range
    before = F.sum(F.col("_last") + 1).over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_begin"))
    return at.join(F.broadcast(begins), "_file").withColumn(name, F.col("_begin") + F.col("_row") + first).drop("_file", "_row", "_begin")
