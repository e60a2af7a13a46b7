"""Connected components of a graph given as pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node of ``pairs`` (columns a, b).

    Every round is written to the shared folder. Edges become stars in a number of rounds that grows with the logarithm
    of the largest component; the work of a round follows the edges, and none of them comes to the driver but for what adaptive
    execution has measured to be small: files, sized by their compressed bytes, are not broadcast.
    """
    with common.measured_broadcasts(pairs.sparkSession):
        return _components(pairs, most_rounds)


def _components(pairs: DataFrame, most_rounds: int) -> DataFrame:
    edges = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = common.written(edges, "edges")
    state = None
    for _ in range(most_rounds):
        moved = common.written(_small_star(_large_star(edges)), "edges")
        now = moved.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        common.forget(edges)
        edges, before, state = moved, state, (now["n"], now["h"])
        if before == state:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
