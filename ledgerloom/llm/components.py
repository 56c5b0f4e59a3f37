"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import written


#: Links (16 bytes each) that one task joins at once; more go through rounds over all tasks.
TASK_LINKS = 1 << 20


def joined_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node joined with it) of all nodes of some links."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def _few(links: DataFrame) -> DataFrame:
    """The components of links that are no more than TASK_LINKS."""

    def join_up(batches):
        batches = list(batches)
        if batches:
            a, b = (np.concatenate([batch.column(c).to_numpy() for batch in batches]) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined_links(a, b)], names=["node", "component"])

    return links.repartition(1).mapInArrow(join_up, "node long, component long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (columns a, b); a component is named by its smallest node.

    Alternates large and small stars: each node hangs its larger, then its smaller neighbours on the
    smallest it knows. A round costs a few shuffles of the links, the number of rounds grows with the logarithm of the
    graph's diameter, and each round's links are written to the shared folder, which cuts lineage. Only counts
    reach the driver. Loops and repeated links change nothing; no links give no rows. Up to TASK_LINKS links are joined by one task without rounds.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b"))
    if edges.count() <= TASK_LINKS:
        return _few(edges)
    edges = written(edges.distinct())
    state = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")))  # a table of its own, so that joins on a large star can be split
        large = both.join(least, F.col("a") == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        large = written(large)
        least = written(large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")))
        small = large.join(least, F.col("a") == F.col("of")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
