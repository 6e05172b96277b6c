"""Connected components of an edge table, by alternating large-star and small-star rounds.

Nothing is collected: a round is two groupings with partial aggregation and two joins on the node; only the number of
changed edges comes to the driver. Every round is checkpointed in the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of every node on the smallest one."""
    if large:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    hung = edges.join(least, F.col("a") == F.col("n"))
    if large:
        return hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.union(moved).where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge to another one; root is the smallest node of its component.

    ``edges`` has two bigint columns a and b; loops, repeats and both directions of an edge are fine.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut_lineage(pairs)
    for _ in range(max_rounds):
        after = cut_lineage(_star(_star(pairs, large=True), large=False))
        same = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == \
            after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        pairs = after
        if same:
            roots = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
