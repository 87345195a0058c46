"""Hash snapshots and move reports as tables: append, list, load, latest, purge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import values


def save(spark: SparkSession, root: str, record: DataFrame, entries: DataFrame) -> None:
    """Appends entries, then the record, which makes them visible. Entries lie in folders by record."""
    entries.write.mode("append").partitionBy("record_id").parquet(f"{root}/entries")
    record.write.mode("append").parquet(f"{root}/records")


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(records, entries): of a save that was cut short there is no record, so its entries aren't read. Ids keep the type that
    records have, whatever the folders' names look like."""
    records = spark.read.parquet(f"{root}/records")
    found = spark.read.parquet(f"{root}/entries").schema
    found["record_id"].dataType = records.schema["record_id"].dataType
    return records, spark.read.schema(found).parquet(f"{root}/entries").join(records.select("record_id").distinct(), "record_id", "left_semi")


def listed(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Records, latest first, with the number of their entries."""
    n = entries.groupBy("record_id").agg(F.count(F.lit(1)).alias("entry_count"))
    return records.join(n, "record_id", "left").withColumn("entry_count", F.coalesce("entry_count", F.lit(0))).orderBy(F.desc("created_at"), "record_id")


def loaded(entries: DataFrame, record_id: str) -> DataFrame:
    """A record's entries; a missing ctime reads as mtime."""
    return entries.filter(F.col("record_id") == record_id).withColumn("ctime", values.created_or_changed("ctime", "mtime"))


def latest(records: DataFrame) -> DataFrame:
    return records.agg(F.max_by(F.struct(*records.columns), F.struct("created_at", "record_id")).alias("r")).filter("r is not null").select("r.*")


def active_hashes(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct hashes of the latest record's active entries."""
    return entries.filter("status = 'active'").join(latest(records).select("record_id"), "record_id", "left_semi").select("hash").distinct()


def purged(entries: DataFrame, moved: DataFrame) -> DataFrame:
    """The entries of every snapshot without the moved paths (src_path, exact)."""
    return entries.join(moved.select(F.col("src_path").alias("file_path")).distinct(), "file_path", "left_anti").select(*entries.columns)


def without(records: DataFrame, entries: DataFrame, record_id: str) -> tuple[DataFrame, DataFrame]:
    return records.filter(F.col("record_id") != record_id), entries.filter(F.col("record_id") != record_id)


def move_report(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of move items (success, size)."""
    return items.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total_selected"), F.count_if("success").alias("total_success"), F.count_if(~F.col("success")).alias("total_failed"), F.coalesce(F.sum(F.when(F.col("success"), F.col("size"))), F.lit(0)).alias("released_bytes"))


def estimate(files: DataFrame) -> DataFrame:
    """Files selected and their bytes; what can't be read counts 0."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(F.coalesce("size", F.lit(0))), F.lit(0)).alias("bytes"))
