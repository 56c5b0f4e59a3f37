"""Groups of things that links join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import written


def joined_groups(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, of): the smallest node that each node of ``links`` (a, b) is joined with, directly or through others.

    In each round every node's larger neighbours move to its smallest neighbour, then all its smaller ones do, which halves paths, so
    the rounds grow with the logarithm of the longest. Each round is written to the shared folder; counts and a checksum are all that the driver sees.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(F.col("a").alias("_of")).agg(F.min("b").alias("_least"))
        outer = written(both.join(lowest, F.col("a") == F.col("_of")).where("b > a").select(F.col("b").alias("a"), F.least("_least", "a").alias("b")).distinct())
        lowest = outer.groupBy(F.col("a").alias("_of")).agg(F.min("b").alias("_least"))
        inner = outer.join(lowest, F.col("a") == F.col("_of")).where("b <> _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
        edges = written(inner.unionByName(lowest.select(F.col("_of").alias("a"), F.col("_least").alias("b"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the groups did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("of")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("of")).distinct())
