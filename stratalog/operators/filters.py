"""Predicates of scans, and keyword scans with their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import paths
from stratalog.schema import KINDS


def has_extension(path: Column | str, extensions: list[str]) -> Column:
    """Any of extensions (any case, dot or not); an empty list passes everything, a path without one fails."""
    wanted = [e.lower().lstrip(".") for e in extensions]
    return F.coalesce(paths.extension(path).isin(*wanted), F.lit(False)) if wanted else F.lit(True)


def at_least(size: Column | str, kib: int) -> Column:
    return F.lit(True) if kib <= 0 else (F.col(size) if isinstance(size, str) else size) >= kib * 1024


def large_enough(width: Column, height: Column, least_width: int, least_height: int) -> Column:
    """False also where the header can't be read."""
    return F.coalesce((width >= least_width) & (height >= least_height), F.lit(False))


def keyword(games: Column | str, word: str) -> Column:
    """Any of an array equals word, ASCII case ignored."""
    w = word.strip()
    if not w:
        raise ValueError("the keyword is empty")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fold = lambda c: F.translate(c, upper, lower)
    return F.exists(F.col(games) if isinstance(games, str) else games, lambda g: fold(g) == fold(F.lit(w)))


def of_kind(df: DataFrame, kind: str) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    return df.filter(F.col("kind") == kind)


def selected(plan: DataFrame, chosen: DataFrame | None, column: str = "old_path") -> DataFrame:
    """All rows without a choice, else those chosen."""
    return plan if chosen is None else plan.join(chosen.select(column).distinct(), column, "left_semi")


def scan_summary(scanned: DataFrame, matched: Column) -> DataFrame:
    """Rows scanned, matched and failed (error isn't null)."""
    return scanned.agg(F.count_if(matched & F.col("error").isNull()).alias("matches"), F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def distinct_ignoring_case(df: DataFrame, column: str, order_col: str = "ordinal") -> DataFrame:
    """The first row of each value, case ignored."""
    row = F.struct(*df.columns)
    return df.groupBy(F.lower(column).alias("_k")).agg(F.min_by(row, order_col).alias("_r")).select("_r.*")
