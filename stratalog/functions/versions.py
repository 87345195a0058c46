"""Version order as a sortable array.

A version is split at everything that isn't a letter or digit; parts are compared one by one, missing ones
count as 0, numbers (up to 64 unsigned bits) by value and above any text, texts by bytes; equal ones by the
raw string. Keys are padded to `width` parts, the most that any compared version has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MOST = "18446744073709551615"
ZERO = "1" + "0" * 20


def parts(version: Column) -> Column:
    return F.filter(F.split(F.lower(version), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _part(x: Column) -> Column:
    digits = F.lpad(F.regexp_replace(x, "^0+", ""), 20, "0")
    number = x.rlike("^[0-9]+$") & (F.length(F.regexp_replace(x, "^0+", "")) <= 20) & (digits <= _MOST)
    return F.when(number, F.concat(F.lit("1"), digits)).otherwise(F.concat(F.lit("0"), x))


def key(version: Column, width: Column) -> Column:
    """An array of width + 1 strings that sorts like the version."""
    own = F.transform(parts(version), _part)
    return F.concat(own, F.array_repeat(F.lit(ZERO), F.greatest(width - F.size(own), F.lit(0))), F.array(version))


def with_key(df: DataFrame, version: str, within: list[str], name: str = "version_key") -> DataFrame:
    """df with a key that is comparable within the groups of `within`."""
    width = F.max(F.size(parts(F.col(version)))).over(Window.partitionBy(*within))
    return df.withColumn(name, key(F.col(version), width))
