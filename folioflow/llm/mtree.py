"""Exact top-k inner products by best-first search of M-trees (Ciaccia, Patella and Zezula, 1997).

Vectors x are lifted to (x, sqrt(M**2 - |x|**2)) with M the largest norm, and queries q to (q, 0): then the squared Euclidean
distance is |q|**2 + M**2 - 2 q.x, so that the nearest are those of the highest inner product. Every partition of the rows
builds a tree of pages. A page's entries hold the distance to the parent's pivot, and inner entries a covering radius.
A query visits pages by their least possible distance; an entry whose stored distance to the parent's pivot rules it out by
the triangle inequality is left without computing its own. Scores are integers, computed exactly, ties to the smaller id;
pruning keeps a margin above rounding errors.

Rows go to trees by the nearest of as many pivots, taken from the sample below, so that a tree covers a region and its root can
rule it out; trees are of about equal size, so a region of many rows (one vector many times over) takes several. Each tree is a task. Queries go
to every tree in blocks of rows, and start with a bound from a bounded sample, the same for all trees: the k-th best score among
SAMPLE rows is no more than the k-th best of all. Trees return k rows a query, which a window ranks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

PAGE = 256
FANOUT = 16
SAMPLE = 1024
QUERY_BLOCK = 512
MARGIN = 1e-6


class Node:
    """A page: pivot, children or row numbers, each entry's distance to the pivot, and the covering radii of children."""

    __slots__ = ("pivot", "radius", "children", "rows", "to_pivot", "pivots", "radii")


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: float) -> None:
        self.ids, self.bound = ids, bound
        flat = vectors.astype(np.float64)
        # no partial sum of an inner product exceeds bound, and doubles hold whole numbers below 2**53 exactly
        self.vectors = flat if bound < 1 << 53 else vectors
        self.points = np.concatenate([flat, np.sqrt(np.maximum(bound - (flat**2).sum(1), 0))[:, None]], 1)
        self.root = self._build(np.arange(len(ids)), 0) if len(ids) else None

    def _distance(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - point) ** 2).sum(1))

    def _build(self, rows: np.ndarray, level: int) -> Node:
        node = Node()
        node.pivot = self.points[rows].mean(0)
        d = self._distance(rows, node.pivot)
        node.radius, node.children, node.rows = float(d.max()), None, None
        if len(rows) <= PAGE:
            order = np.argsort(d, kind="stable")
            node.rows, node.to_pivot = rows[order], d[order]
            return node
        # seeds spread over the rows by distance; groups without progress (equal vectors) are cut evenly
        seeds = rows[np.argsort(d, kind="stable")[np.linspace(0, len(rows) - 1, FANOUT).astype(int)]]
        nearest = np.stack([self._distance(rows, self.points[s]) for s in seeds]).argmin(0)
        groups = [rows[nearest == g] for g in range(FANOUT)]
        groups = [g for g in groups if len(g)]
        if max(map(len, groups)) > 0.9 * len(rows):
            groups = np.array_split(rows[np.argsort(d, kind="stable")], min(FANOUT, -(-len(rows) // PAGE)))
        node.children = [self._build(g, level + 1) for g in groups]
        node.pivots = np.stack([c.pivot for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.to_pivot = np.sqrt(((node.pivots - node.pivot) ** 2).sum(1))
        return node

    def top(self, own: int, query: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but the query's own; fewer if the others score below `least`."""
        if self.root is None:
            return []
        point, own_query = np.append(query.astype(np.float64), 0.0), query.astype(self.vectors.dtype)
        base = float((point**2).sum()) + self.bound
        best: list[tuple[int, int]] = []  # heap of (score, -id)

        def reach() -> float:
            score = best[0][0] if len(best) == k else least
            score = score if least is None or score is None else max(score, least)
            return np.inf if score is None else float(np.sqrt(max(base - 2.0 * score, 0.0))) * (1 + MARGIN) + MARGIN

        start = float(np.sqrt(((self.root.pivot - point) ** 2).sum()))
        queue, tick = [(max(0.0, start - self.root.radius), 0, start, self.root)], 0
        limit = reach()
        while queue:
            low, _, d, node = heapq.heappop(queue)
            if low > limit:
                break
            near = np.abs(d - node.to_pivot)
            if node.rows is not None:
                rows = node.rows[near <= limit]
                scores = self.vectors[rows] @ own_query
                floor = best[0][0] if len(best) == k else -(1 << 62)
                floor = max(floor, least) if least is not None else floor
                for i in np.flatnonzero(scores >= floor).tolist():
                    row = rows[i]
                    if self.ids[row] != own:
                        entry = (int(scores[i]), -int(self.ids[row]))
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                limit = reach()
            else:
                some = np.flatnonzero(near - node.radii <= limit)
                far = np.sqrt(((node.pivots[some] - point) ** 2).sum(1))
                for i, x in zip(some.tolist(), far.tolist()):
                    least_possible = max(0.0, x - float(node.radii[i]))
                    if least_possible <= limit:
                        tick += 1
                        heapq.heappush(queue, (least_possible, tick, x, node.children[i]))
        return [(s, -i) for s, i in best]


def _matrix(column: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, raw in enumerate(column):
        x = np.frombuffer(raw, np.int64)
        out[i, : len(x)] = x
    return out


def _labels(spark: SparkSession, trees: int) -> Column:
    """An array of integers, one for each tree, whose hashes fall into as many partitions one by one."""
    found = spark.range(64 * trees).select(F.col("id").cast("int").alias("label")).select("label", F.pmod(F.hash("label"), F.lit(trees)).alias("p"))
    least = {r.p: r.label for r in found.groupBy("p").agg(F.min("label").alias("label")).collect()}
    spare = iter(set(range(trees)) - set(least.values()))
    return F.array(*(F.lit(least[p] if p in least else next(spare)) for p in range(trees)))


def _regions(held: Broadcast, width: int, trees: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the number of the nearest pivot among the first of the sample."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = np.unique(held.value[1][:trees].astype(np.float64), axis=0)
        half = (pivots**2).sum(1) / 2
        for batch in batches:
            region = (_matrix(batch.column(1).to_pylist(), width).astype(np.float64) @ pivots.T - half).argmax(1) if len(pivots) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(region.astype(np.int32))], names=["vec_id", "v", "region"])

    return near


def nearest_by_inner_product(vectors: DataFrame, k: int = 10, query_every: int = 100, scale: int = 1024, trees: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest inner products of every query with all other rows.

    vectors: vec_id, embedding. A component x counts as floor(scale * x) as an integer; vectors whose inner products 64 bits can't
    hold are an error. Queries are the rows
    whose vec_id is divisible by query_every. Rows with a null id, a null vector, or a null or non-finite component take no part; shorter
    vectors count as filled up with 0; repeated ids are rows of their own, except that none is compared with a query of its
    id; ties go to the smaller vec_id. A query alone in the table has no row; other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(x, np.int64).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["vec_id", "v"])

    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x)).alias("norm")).first()
    width, bound = int(size.width or 0), float(size.norm or 0.0)
    if bound >= 1 << 62:
        raise ValueError(f"squared norms of up to {bound:.3g} leave 64 bits")
    trees = trees or max(1, -(-size.n // 16384), vectors.sparkSession.sparkContext.defaultParallelism)
    rows = written(rows.mapInArrow(packed, "vec_id long, v binary"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().to_pylist()
    held = vectors.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in sample], np.int64), _matrix([r["v"] for r in sample], width)))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                own, q = part.column(0).to_numpy(), _matrix(part.column(1).to_pylist(), width)
                scores = np.where(ids[:, None] == own[None, :], -(1 << 62), known @ q.T)
                least = np.sort(scores, axis=0)[-k] if len(ids) >= k else np.full(len(own), -(1 << 62))
                yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary()), pa.array([least.astype(np.int64).tobytes()], pa.binary())], names=["ids", "queries", "least"])

    queries = rows.where(f"vec_id % {query_every} = 0").distinct().mapInArrow(bounded, "ids binary, queries binary, least binary")
    sent = queries.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    labels = _labels(vectors.sparkSession, trees)
    sent = sent.withColumn("tree", F.element_at(labels, F.col("tree") + 1))
    dealt = written(rows.mapInArrow(_regions(held, width, trees), "vec_id long, v binary, region int"))
    # regions one after the other, cut into trees of equal numbers of rows; at most as many regions as trees
    sizes = dealt.groupBy("region").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("first", F.sum("n").over(W.orderBy("region").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    share = F.pmod(F.hash("vec_id", "v"), F.lit(1 << 20)) / float(1 << 20)
    place = F.floor((F.col("first") + share * F.col("n")) * trees / max(1, size.n)).cast("int")
    parts = dealt.join(F.broadcast(sizes), "region").select("vec_id", "v", F.element_at(labels, place + 1).alias("tree"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        tree = MTree(left.column("vec_id").to_numpy(), _matrix(left.column("v").to_pylist(), width), bound)
        out: list[tuple[int, int, int]] = []
        for block in right.to_pylist():
            ids, least = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["least"], np.int64)
            q = np.frombuffer(block["queries"], np.int64).reshape(len(ids), width)
            for i in range(len(ids)):
                floor = int(least[i])
                out += [(int(ids[i]), v, s) for s, v in tree.top(int(ids[i]), q[i], k, floor if floor > -(1 << 62) else None)]
        return pa.table({n: pa.array([x[j] for x in out], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    found = parts.repartition(trees, "tree").groupBy("tree").cogroup(sent.repartition(trees, "tree").groupBy("tree")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
