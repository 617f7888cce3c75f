"""Exact top-k by inner product with two cover trees, one over queries and one over data.

Vectors are dealt into blocks of a few thousand by a hash, so copies spread
evenly; every query visits every block, and each block returns its own best.
Within a block, a pair of nodes is dropped when even the best inner product that
their centres and covering radii allow stays below the worst k-th score of the
queries in the node.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import prepare
from meterloom.session import cut

BLOCK_ROWS = 8192
QUERIES = 1024
LEAF = 64
#: Covering radii shrink by this factor from a node to its children.
BASE = 1.3
NONE = -(1 << 62)


class CoverTree:
    """Nodes with a centre of their own, covering radius and either children or points.

    Children's centres lie more than ``radius / BASE`` apart and cover the node
    within it. A node stays a leaf when it is small, or when its points are so
    far from each other that more than an eighth of them would be centres.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []  # all points below a node
        self._build()

    def _add(self, members: np.ndarray, center: int, gaps: np.ndarray) -> int:
        self.center.append(center)
        self.radius.append(float(gaps.max()) if len(gaps) else 0.0)
        self.children.append([])
        self.members.append(members)
        return len(self.center) - 1

    def _gaps(self, members: np.ndarray, center: int) -> np.ndarray:
        return np.sqrt(((self.points[members] - self.points[center]) ** 2).sum(1))

    def _build(self) -> None:
        everyone = np.arange(len(self.points))
        todo = [self._add(everyone, 0, self._gaps(everyone, 0))] if len(everyone) else []
        while todo:
            node = todo.pop()
            members, reach = self.members[node], self.radius[node] / BASE
            if len(members) <= LEAF or not self.radius[node]:
                continue
            parts, left, center = [], members, self.center[node]
            while len(left) and len(parts) <= max(8, len(members) // 8):
                gaps = self._gaps(left, center)
                near = gaps <= reach
                parts.append((left[near], center, gaps[near]))
                left = left[~near]
                center = int(left[0]) if len(left) else -1
            if len(left):
                continue
            self.children[node] = [self._add(*part) for part in parts]
            todo += self.children[node]


class Best:
    """The k best of every query so far: score descending, id ascending."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), NONE, dtype=np.int64)
        self.id = np.full((queries, k), np.iinfo(np.int64).max, dtype=np.int64)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score``: rows x candidates; own ids are already at NONE."""
        k = self.score.shape[1]
        some = score.max(1) >= self.score[rows, -1]
        rows, score = rows[some], score[some]
        if not len(rows):
            return
        by_id = np.argsort(ids, kind="stable")
        score, ids = score[:, by_id], ids[by_id]
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        both_score = np.concatenate([self.score[rows], np.take_along_axis(score, top, 1)], 1)
        both_id = np.concatenate([self.id[rows], ids[top]], 1)
        order = np.lexsort((both_id, -both_score), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(both_score, order, 1)
        self.id[rows] = np.take_along_axis(both_id, order, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where every sum is exact there."""
    top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if float(top) ** 2 * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, tree: CoverTree | None = None) -> Best:
    """The k largest inner products of each query with data of another id; unfilled places have score ``NONE``."""
    best = Best(len(queries), k)
    if not len(queries) or not len(data):
        return best
    q, d = CoverTree(queries.astype(np.float64)), tree or CoverTree(data.astype(np.float64))
    norm_q, norm_d = np.sqrt((q.points**2).sum(1)), np.sqrt((d.points**2).sum(1))

    def bound(a: int, b: int) -> float:
        x, y = q.center[a], d.center[b]
        top = float(q.points[x] @ d.points[y]) + d.radius[b] * norm_q[x] + q.radius[a] * norm_d[y] + q.radius[a] * d.radius[b]
        return top + 1e-9 * abs(top) + 0.5  # scores are integers: half a unit absorbs rounding

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        top, a, b = heapq.heappop(heap)
        rows = q.members[a]
        if -top < best.score[rows, -1].min():
            continue
        below_q, below_d = q.children[a], d.children[b]
        if not below_q and not below_d:
            columns = d.members[b]
            score = products(queries[rows], data[columns])
            score[query_ids[rows][:, None] == data_ids[columns][None, :]] = NONE + 1
            best.offer(rows, score, data_ids[columns])
        elif below_d and (not below_q or d.radius[b] >= q.radius[a]):
            for c in below_d:
                heapq.heappush(heap, (-bound(a, c), a, c))
        else:
            for c in below_q:
                heapq.heappush(heap, (-bound(c, b), c, b))
    best.score[best.score == NONE + 1] = NONE
    return best


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query row with all rows of another id.

    ``is_query`` is a column over ``vectors``. Components become floor(scale * x).
    Ties go to the smaller id. Rows with a null id or vector, or a null or
    non-finite component, take no part; vectors of unlike length do not meet;
    fewer candidates than ``k`` are all returned. Rows that repeat an id count
    each as a candidate. Scores must fit a long.
    """
    spark = vectors.sparkSession
    prepare(spark)
    x = F.col(vector_col)
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    finite = F.forall(x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")) & ~F.isnan(e.cast("double")))
    rows = cut(vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), F.size("v").alias("dim"), F.lit(0).alias("kind"), "id", "v")
    asked = rows.where("asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.size("v").alias("dim"), F.lit(1).alias("kind"), "id", "v")
    met = dealt.unionByName(asked).repartition("block", "dim").sortWithinPartitions("block", "dim", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fresh, data, tree = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("block", "dim", "kind")], 1)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True]) if len(keys) else []
            for lo, hi in zip(edges, edges[1:]):
                block, dim, kind = keys[lo]
                if at != (block, dim):
                    at, fresh, data, tree = (block, dim), [], None, None
                part = batch.slice(lo, hi - lo)
                ids = part.column("id").to_numpy()
                values = part.column("v").flatten().to_numpy().reshape(len(ids), dim)
                if kind == 0:
                    fresh.append((ids, values))
                    continue
                if not fresh:
                    continue
                if tree is None:
                    data = [np.concatenate(c) for c in zip(*fresh)]
                    tree = CoverTree(data[1].astype(np.float64))
                for a in range(0, len(ids), QUERIES):
                    best = dual_search(values[a : a + QUERIES], ids[a : a + QUERIES], data[1], data[0], k, tree)
                    row, place = np.nonzero(best.score > NONE)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + QUERIES][row]), pa.array(best.id[row, place]), pa.array(best.score[row, place])], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
