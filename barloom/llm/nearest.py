"""Exact nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt to blocks; every block of queries meets every block of candidates in one
tile, by an equi-join on the tile's key. In a tile, vectors are rounded to int8 with a scale and an exact
residual each; the int8 product gives each distance up to the residuals. Candidates whose lower bound
exceeds the k-th smallest upper bound are out; the others are recomputed in double from the original vectors. Each tile
hands on k rows a query; bounded heaps merge them.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

QUERIES_PER_BLOCK, ROWS_PER_BLOCK = 1024, 8192
_RAW = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and dim of the vectors that take part: not null, not empty, all components finite, not zero."""
    bad = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long"), "embedding", F.size("embedding").alias("dim"))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scale and residual norm of each row."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, distance) of each query's k nearest in the tile, ties to the smaller id."""
    (qi, qs, qr), (ci, cs, cr) = rounded(q), rounded(c)
    norm_q = qs**2 * (qi.astype(np.int64) ** 2).sum(1)
    norm_c = cs**2 * (ci.astype(np.int64) ** 2).sum(1)
    whole = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products of int8 stay exact integers
    right = ci.astype(whole).T
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(q), 128):
        dots = (qi[i : i + 128].astype(whole) @ right).astype(np.float64)
        near = np.sqrt(np.maximum(norm_q[i : i + 128, None] + norm_c - 2 * qs[i : i + 128, None] * cs * dots, 0))
        slack = qr[i : i + 128, None] + cr + 1e-9 * (1 + near)
        own = qid[i : i + 128, None] == cid
        upper = np.where(own, np.inf, near + slack)
        at = min(k, upper.shape[1]) - 1
        bar = np.partition(upper, at, axis=1)[:, at]
        row, col = np.nonzero((near - slack <= bar[:, None]) & ~own)
        gap = (q[i + row] - c[col]) ** 2
        exact = np.sqrt(np.cumsum(gap, axis=1)[:, -1])  # summed from the first component to the last
        order = np.lexsort((cid[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        out.append((i + row[rank < k], col[rank < k], exact[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors with the smallest Euclidean distance to each query.

    A query never finds its own vec_id. Vectors of another dimension than the query's are no candidates.
    Rows that repeat a vec_id count once: the smallest vector of an id stands for it. Fewer candidates than k
    give fewer rows, none give none; empty tables give an empty result. Other columns aren't read.
    """
    one = lambda df: stored(usable(df).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "vectors")
    rows, asked = one(vectors), one(queries)
    n_rows, n_asked = max(1, math.ceil(rows.count() / ROWS_PER_BLOCK)), max(1, math.ceil(asked.count() / QUERIES_PER_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", block(n_asked)).withColumn("r", each(n_rows))
    right = rows.withColumn("r", block(n_rows)).withColumn("q", each(n_asked))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            got = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        else:
            dim = a.column("dim")[0].as_py()
            qid, cid = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
            i, j, score = tile(qid, _matrix(a, dim), cid, _matrix(b, dim), k)
            got = [qid[i], cid[j], score]
        return pa.table(got, names=["query_id", "vec_id", "score"])

    tiles = left.groupBy("dim", "q", "r").cogroup(right.groupBy("dim", "q", "r")).applyInArrow(meet, _RAW)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = defaultdict(list)
        for b in batches:
            for query, vec, score in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                heap, item = heaps[query], (-score, -vec)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        found = [(query, rank, -v, -s) for query, heap in heaps.items() for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        if found:
            query, rank, vec, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(rank, pa.int32()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["query_id", "rank", "vec_id", "score"])

    return tiles.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""
