"""Connected components of an edge list, by alternating star contraction.

Every round replaces edges by stars around the smallest neighbour (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): a large step links all larger neighbours of a node to
its smallest one, a small step all smaller neighbours. Both are an aggregate with map-side combine
and an equi-join, so that a node with very many edges is pre-aggregated and its join partition can
be split. Before it, each partition replaces its edges by a spanning forest, which bounds the rows
by the nodes a partition holds. Rounds contract the graph until LOCAL_EDGES edges are left, however many there were; one task
finishes these. Nothing goes to the driver; each round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Edges, of 16 bytes each, that one task holds.
LOCAL_EDGES = 1 << 18

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Union:
    """Union by smallest root over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as (node, smallest node of its tree). Merged as it grows, to hold a node once."""
    held = np.zeros((0, 2), np.int64)
    more: list[np.ndarray] = []

    def merge() -> np.ndarray:
        edges = np.concatenate([held, *more])
        nodes, at = np.unique(edges, return_inverse=True)
        union = Union(len(nodes))
        for a, b in at.reshape(-1, 2).tolist():
            union.join(a, b)
        root = np.array([union.find(i) for i in range(len(nodes))], np.int64)
        keep = root != np.arange(len(nodes))
        return np.stack([nodes[keep], nodes[root[keep]]], 1) if len(nodes) else held

    for batch in batches:
        more.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1))
        if sum(map(len, more)) > 500_000:
            held, more = merge(), []
    held = merge() if more else held
    for i in range(0, len(held), 100_000):
        part = held[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], schema=_EDGES)


def _stars(edges: DataFrame) -> bool:
    """Whether every node that points somewhere points to one node, which points nowhere."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and in > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a long, b long) that has a neighbour; component is the smallest
    node reachable. Loops and rows with a null are ignored; an empty table gives an empty table."""
    now = written(edges.select("a", "b").where("a <> b").distinct().mapInArrow(forest, "a long, b long"))
    while now.count() > LOCAL_EDGES and not _stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = large.join(low, "a").select(F.inline(ends)).where("a <> b").distinct()
        now = written(small.mapInArrow(forest, "a long, b long"))
    if now.count() <= LOCAL_EDGES:
        now = written(now.coalesce(1).mapInArrow(forest, "a long, b long"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
