"""Connected components by alternating large and small stars, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.common import staged


def _star(near: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """near: (u, v). The least of v for each u, and near joined with it; sums before it shuffles, hot u are split by AQE."""
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    return least, near.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component.

    Each round is written to the shared folder, so a lost executor costs one round. Rounds grow with the logarithm of
    a component's size. Null nodes and loops are left out.
    """
    now = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        near = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        _, met = _star(near, "large")
        large = met.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least, met = _star(large, "small")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
