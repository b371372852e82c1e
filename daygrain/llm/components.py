"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from daygrain.llm.common import as_table

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b")
            .where("a < b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself move to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    moved = links.join(least, "b").select(F.col("least").alias("a"), F.col("a").alias("b")).where("a < b")
    return moved.union(least.select(F.col("least").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b with a < b); component is its smallest node.

    Links and labels stay in tables; the driver sees two sums a round. Minima are taken by a
    partially aggregated ``min`` and joined back, so a hub's links need not meet in one task.
    Empty links give no rows.
    """
    links = as_table(links.distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        links = as_table(_small_star(_large_star(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
