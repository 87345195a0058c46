"""Lookups by id: distinct requests, results joined back, counts of row states."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import values

BROADCAST_ROWS = 200_000


def requests(rows: DataFrame, key: str = "pid") -> DataFrame:
    return rows.select(key).filter(F.col(key).isNotNull()).distinct()


def join_back(rows: DataFrame, results: DataFrame, key: str = "pid", order_col: str = "arrival") -> DataFrame:
    """rows with the last result of their key and status: pending, ok or error. Results are broadcast only where
    they are counted to be few; else both sides shuffle and skewed keys are split."""
    value = F.struct(*[c for c in results.columns if c != key])
    last = results.groupBy(key).agg(F.max_by(value, order_col).alias("result"))
    few = last.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(last) if few else last, key, "left")
    status = F.when(F.col("result").isNull(), "pending").when(F.col("result.error").isNotNull(), "error").otherwise("ok")
    return out.withColumn("status", status)


def state_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "pending").alias("done"), F.count_if(F.col("status") == "error").alias("errors"))


class LookupFailed(Exception):
    """What fetch raises: a status code, or a message."""

    def __init__(self, code: int | None = None, message: str = ""):
        super().__init__(message or f"status {code}")
        self.code, self.message = code, message


def fetched(keys: DataFrame, fetch: Callable[[str], list[str]], key: str = "pid", permits: int = 8, seconds: float = 0.0) -> DataFrame:
    """(key, tags, error, arrival) of keys: fetch(key) gives tags or raises. At most `permits` (1 to 8) lookups run at a
    time, one a task, each at least `seconds` after the one before in its task; a failed lookup is a row with its error."""
    permits = min(max(permits, 1), 8)

    def run(frames):
        last = 0.0
        for f in frames:
            tags, codes, errors, at = [], [], [], []
            for k in f[key].astype(str):
                time.sleep(max(0.0, last + seconds - time.monotonic()))
                last = time.monotonic()
                try:
                    tags.append(fetch(k)), codes.append(None), errors.append(None)
                except LookupFailed as e:
                    tags.append(None), codes.append(e.code), errors.append(e.message or None)
                except (OSError, ValueError) as e:
                    tags.append(None), codes.append(None), errors.append(str(e) or type(e).__name__)
                at.append(time.time_ns())
            yield pd.DataFrame({key: f[key], "tags": tags, "code": pd.array(codes, "Int32"), "message": errors, "arrival": at})

    kind = dict(keys.dtypes)[key]
    found = keys.select(key).repartition(permits).mapInPandas(run, f"{key} {kind}, tags array<string>, code int, message string, arrival long")
    error = F.coalesce("message", F.when(F.col("code").isNotNull(), values.http_text("code")))
    return found.select(key, "tags", error.alias("error"), "arrival")
