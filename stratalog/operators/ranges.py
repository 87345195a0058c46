"""Running values over an order that no single task has to see.

Rows are sorted into ranges and written; each range has its own running value, and what the ranges before it leave is added. A
group of any size spreads over ranges, as the order cuts it, too. `save(df) -> df` writes a table: the ranges' bounds come from a
sample, so they must not be drawn again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"
_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)


def ranged(df: DataFrame, order: list[str], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df in ranges of `order`, as a written table with the range's number."""
    return save(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, save: Callable[[DataFrame], DataFrame], name: str, whole: str | None = None) -> DataFrame:
    """df with the sum of `value` so far within `by` (no nulls), this row included; with `whole`, also that of all the group's rows."""
    cut = ranged(df.withColumn("_value", value), [*by, *order], save)
    local = cut.withColumn("_own", F.sum("_value").over(Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(*_SO_FAR)))
    # a row for each group of a range
    sums = cut.groupBy(RANGE, *by).agg(F.sum("_value").alias("_sum"))
    group = Window.partitionBy(*by)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(group.orderBy(RANGE).rowsBetween(*_BEFORE)), F.lit(0)))
    if whole:
        sums = sums.withColumn(whole, F.sum("_sum").over(group))
    out = local.join(sums.drop("_sum"), [RANGE, *by])
    return out.withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_value", RANGE)


def rate_slots(events: DataFrame, interval: int, time_col: str, order: list[str], save: Callable[[DataFrame], DataFrame], name: str = "slot") -> DataFrame:
    """slot: max(slot before + interval, own time), over all events as one sequence. Of a range it takes the number of its events and the
    largest time less interval for each event before it in the range; both add up over the ranges before."""
    if interval <= 0:
        return events.withColumn(name, F.col(time_col))
    cut = ranged(events, order, save)
    own = Window.partitionBy(RANGE).orderBy(*order)
    local = cut.withColumn("_i", F.row_number().over(own) - 1).withColumn("_base", F.max(F.col(time_col) - F.col("_i") * interval).over(own.rowsBetween(*_SO_FAR)))
    # a row for each range
    ends = local.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n"), F.max("_base").alias("_most"))
    ends = ends.withColumn("_at", F.coalesce(F.sum("_n").over(Window.orderBy(RANGE).rowsBetween(*_BEFORE)), F.lit(0)))
    ends = ends.withColumn("_carried", F.max(F.col("_most") - F.col("_at") * interval).over(Window.orderBy(RANGE).rowsBetween(*_BEFORE)))
    out = local.join(F.broadcast(ends.select(RANGE, "_at", "_carried")), RANGE)
    slot = (F.col("_at") + F.col("_i")) * interval + F.greatest(F.col("_base") - F.col("_at") * interval, "_carried")
    return out.withColumn(name, slot).drop("_i", "_base", "_at", "_carried", RANGE)
