"""Folders and tables that all executors share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch, on both sides of the pipe to Python, unless the session sets its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: the default of 10,000 rows a batch would be hundreds of megabytes."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def give_back(collect: bool = True) -> None:
    """Returns freed memory to the system, where the C library can; after a fit the driver has jobs to run beside the JVM,
    and so has a worker after large arrays."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and all runs in one JVM, one under the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        if path := getattr(t, "_shared_path", None):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: keys that may be told apart as hot at once, 16 to 40 bytes each in a broadcast
HOT_KEYS = 100_000


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner", least: int = 128) -> DataFrame:
    """left (a written table, as it is read more than once) joined with right on `key`, where a key may have any share of
    left's rows: one of more than `least` rows is dealt to several tasks by `spread`, with right's rows repeated for each.
    Those keys are broadcast; there are HOT_KEYS of them at most, since `least` grows with left."""
    if (n := left.count()) <= least:
        return left.join(right, key, how)
    least = max(least, -(-n // HOT_KEYS))
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).select(key, F.ceil(F.col("_n") / least).cast("long").alias("_k"))
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_k")), F.lit(0))
    own = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_k")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_k", F.lit(1)) - 1))
    return own.join(right.join(F.broadcast(hot), key, "left").withColumn("_salt", copies).drop("_k"), [key, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
