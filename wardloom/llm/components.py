"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lineage import cut


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node to the smallest that the edges of its batch lead to: what each batch can settle by itself."""
    for batch in batches:
        nodes, of = np.unique(np.stack([np.asarray(batch.column(c), np.int64) for c in ("a", "b")]), return_inverse=True)
        up = list(range(len(nodes)))
        for x, y in zip(*of.reshape(2, -1).tolist(), strict=True):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            up[max(x, y)] = min(x, y)
        for i, x in enumerate(up):  # parents are smaller, so they are settled before
            up[i] = up[x]
        root = nodes[up]
        moved = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(root[moved])], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: the neighbours of a node are linked with the smallest of them and the node itself.

    Large: only the neighbours above the node move. Small: only those below it, and the node.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Both sides are dealt by node: nothing that grows with the graph is broadcast, and a node with very many links is split.
    joined = both.join(lowest.hint("shuffle_merge"), "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = joined.select("b", "m").unionByName(lowest.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): of each node with an edge, the smallest node that it reaches. ``edges``: a, b, in any order."""
    edges = cut(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_forest, "a long, b long").distinct())
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
        edges = cut(_star(_star(edges, large=True), large=False))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Every edge now leads from a node to the smallest of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
