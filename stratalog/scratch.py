"""A folder that the driver and all executors share, for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def mounted(spark: SparkSession, name: str) -> str:
    """A folder as a path of a file system that driver and executors have mounted; ValueError where the shared one is another kind."""
    at = folder(spark, name)
    if "://" in at and not at.startswith("file:/"):
        raise ValueError(f"files on {at} can't be reached by path; share a mounted folder")
    return "/" + at.removeprefix("file:").lstrip("/")


def save(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a written table."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
