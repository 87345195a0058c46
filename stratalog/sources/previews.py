"""Previews of content, and settings kept as JSON text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from stratalog.functions import names, values


_SHOWN = T.StructType([T.StructField("content", T.StringType()), T.StructField("size", T.LongType()), T.StructField("truncated", T.BooleanType())])


@pandas_udf(_SHOWN)
def _shown(content: pd.Series, limit: pd.Series) -> pd.DataFrame:
    out = []
    for c, n in zip(content, limit):
        if c is None:
            out.append((None, None, None))
            continue
        end = min(len(c), n)
        # back to where no character goes on, if something was cut off
        while len(c) > n and end > 0 and c[end] & 0xC0 == 0x80:
            end -= 1
        out.append((c[:end].decode(errors="replace"), end, len(c) > n))
    return pd.DataFrame(out, columns=["content", "size", "truncated"])


def preview(content: Column | str, kib: int = 256) -> Column:
    """The first kib KiB as text: struct<content, size, truncated>. What is longer is cut before the character at the limit, and
    size tells the bytes left; bytes that aren't UTF-8 are replaced."""
    c = F.col(content) if isinstance(content, str) else content
    # three bytes more tell whether a character goes on
    return _shown(F.substring(c, 1, kib * 1024 + 3), F.lit(kib * 1024))


def text_preview(content: Column | str, kib: int = 256) -> Column:
    """The content alone."""
    return preview(content, kib)["content"]


def dispatch(files: DataFrame, path_col: str = "path") -> DataFrame:
    return files.withColumn("preview", names.preview_kind(path_col))


def as_payload(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def settings(rows: DataFrame, lists: list[str], maps: list[str], defaults: dict) -> DataFrame:
    """One row of settings: JSON columns parsed (default where they don't parse), others with their defaults."""
    out = rows.withColumns({c: values.text_list(c) for c in lists} | {c: values.text_map(c) for c in maps})
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def lines(spark, path: str) -> DataFrame:
    return spark.read.text(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def save_settings(row: DataFrame, path: str, version: int) -> None:
    """Keeps a whole row of settings; the highest version counts, so a reader sees the old row or the new one."""
    row.limit(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_settings(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.agg(F.max_by(F.struct(*[c for c in rows.columns if c != "version"]), "version").alias("r")).select("r.*")
