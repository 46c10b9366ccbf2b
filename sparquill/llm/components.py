"""Connected components of an edge table, by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import drop_written, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): every node of edges(u, v) that isn't the least of its component, with the least.

    Each round is written to the shared folder, so that no lineage grows. A path of n nodes takes
    about log n rounds; more than max_rounds is an error, never a partial result.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now = written(ordered, "components")
    before = _state(now)
    for _ in range(max_rounds):
        # Large star: a node's larger neighbours join its least neighbour (or the node itself).
        near = _both(now)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = near.join(least, near["u"] == least["c"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours join the least of them.
        large = large.distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(small_least, large["u"] == small_least["c"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(small_least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        after = written(small.distinct(), "components")
        state = _state(after)
        drop_written(now)
        now = after
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
