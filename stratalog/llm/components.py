"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.shared import discard, salted_join, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a long, b long), loops allowed -> (node, root): the smallest id reachable from each node that
    has a larger one; roots and lone nodes have no row. Each step is written to the shared folder, and a hub's
    edges are dealt to several tasks."""
    spark = edges.sparkSession
    now = written(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), name)
    before = None
    while (mark := tuple(now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())) != before:
        before = mark
        if not mark[0]:
            break
        both = now.unionByName(now.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(salted_join(both, low, "a", F.col("b")).filter("b > a").selectExpr("b a", "m b").filter("a <> b").distinct(), name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, low, "a", F.col("b")).selectExpr("b a", "m b").filter("a <> b").unionByName(low.selectExpr("a", "m b")).distinct()
        old, now = now, written(small, name)
        discard(spark, old, large)
    out = now.selectExpr("a node", "b root")
    out._shared_path = now._shared_path
    return out
