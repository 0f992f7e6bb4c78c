"""Connected components of a link table by alternating large and small stars, without any graph on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

#: Edges (some 50 bytes each) that one task takes: a round of so few in many partitions is but overhead.
SMALL = 100_000


def _large(edges: DataFrame, fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = fit(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame, fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return fit(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))


def connected_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``node`` and ``root`` (smallest node) of every node but the roots. ``edges`` has columns ``a`` and ``b``; null ends are ignored.

    Each round is checkpointed. The rounds grow with the logarithm of the longest path. At most ``small`` edges go through one partition.
    """
    now = edges.where("a <> b").select("a", "b").distinct().checkpoint()
    few = now.count() <= small
    fit = lambda df: df.coalesce(1) if few else df
    now = fit(now)
    seen = None
    while True:
        now = _small(_large(now, fit), fit).where("a <> b").distinct().checkpoint()
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(mark)
