"""Connected components by alternating star contraction, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import is_empty, stored


def _towards_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every node links its neighbours (or itself and its smaller neighbours) to the least of them."""
    if larger_only:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    linked = around.join(least, "u")
    if larger_only:
        moved = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = linked.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            least.select("u", F.col("least").alias("v"))
        )
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the component's least node.

    ``edges`` has columns u and v of one orderable type; loops, repeats and
    either direction are allowed. Every round is written to the shared folder,
    so a lost executor repeats part of one round. The loop ends when a round
    changes nothing, after about the logarithm of the longest path.
    """
    now = stored(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct())
    if is_empty(now):
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    for _ in range(max_rounds):
        large = _towards_minimum(now, larger_only=True)
        now = stored(_towards_minimum(large, larger_only=False))
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
