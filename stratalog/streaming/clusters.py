"""Leader clustering of signatures as they come: each trigger is decided against the heads so far.

Heads never change and come before all that arrives later, so a file joins the first head within range that is there, and
only those that none takes are clustered among themselves; their heads are added. What a trigger reads of the past are the heads
alone. It writes its files and new heads under its number, and reads those of lower numbers, so one that is run again replaces its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import similarity
from stratalog.operators.streams import numbered

_HEADS = "ordinal long, words array<bigint>"
#: more files than a trigger ever has
SPAN = 1 << 40


def clusters_into(path: str, distance: int, bits: int, order: list[str], save: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink for batches with `words`. A file's ordinal is the trigger's number times SPAN and its place by `order` there; files get
    head (an ordinal) and head_distance. save(df) -> df writes a table."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = save(numbered(batch, order, save, number * SPAN, "ordinal"))
        heads = spark.read.schema(_HEADS + ", batch long").option("basePath", f"{path}/heads").parquet(f"{path}/heads").filter(F.col("batch") < number) if number else spark.createDataFrame([], _HEADS)
        taken = save(similarity.nearest_heads(files, heads.select("ordinal", "words"), distance, bits, save))
        left = files.join(taken, "ordinal", "left_anti")
        own = similarity.leaders(left, distance, bits, save).select(*files.columns, "head", "head_distance")
        done = save(files.join(taken, "ordinal").select(*own.columns).unionByName(own))
        done.write.mode("overwrite").parquet(f"{path}/files/batch={number}")
        new = done.filter("head = ordinal").select("ordinal", "words")
        new.write.mode("overwrite").parquet(f"{path}/heads/batch={number}")

    return sink


def clustered(spark: SparkSession, path: str) -> DataFrame:
    """All files with their heads."""
    return spark.read.parquet(f"{path}/files").drop("batch")
