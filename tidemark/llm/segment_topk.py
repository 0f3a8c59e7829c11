"""Exact top-k by multi-resolution segment statistics: coarse bounds first, exact scores for what survives.

A vector is cut into segments of equal length; per segment it keeps its mean and its deviation (the norm of
what is left after the mean is taken away). For two segments of length m the inner product is at most
m * mean * mean' + deviation * deviation' (Cauchy-Schwarz), and |x - y|**2 is at least
m * (mean - mean')**2 + (deviation - deviation')**2, so a pair whose bound can't reach a query's k-th best score
so far is dropped. Levels go from few segments to many. At each the most promising candidates are scored exactly,
which raises the k-th best score so far, and only vectors that some query of the tile still needs go on to the next
level; only survivors of the last are scored, as one product where most of a tile's pairs are left.

Queries and vectors are dealt into blocks of about BLOCK rows by hash; each pair of blocks is one group, which
returns its k best per query, and the groups' results are ranked once more. So a task holds two blocks at a
time, however many rows there are or repeat, and no row is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
LEVELS = (1, 4, 16, 32)
DENSE = 0.02
TILE = 256
"""Queries that are compared with a block at a time."""


def usable(vector: Column) -> Column:
    """Whether the vector is there, has components, and all of them are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means scaled by the root of the segment length, and deviations, of each segment; a last short one is padded with zeros."""
    size = -(-x.shape[1] // segments)
    padded = np.zeros((len(x), size * segments))
    padded[:, : x.shape[1]] = x
    parts = padded.reshape(len(x), segments, size)
    mean = parts.mean(axis=2)
    return mean * np.sqrt(size), np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))


def block_topk(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vector ids, scores): each query's k best inner products in the block, ties to the smaller id. Integer components."""
    big = max(int(np.abs(q).max(initial=0)), int(np.abs(v).max(initial=0))) ** 2 * max(1, q.shape[1]) >= 1 << 52
    exact_q, exact_v = (q.astype(object), v.astype(object)) if big else (q.astype(float), v.astype(float))
    q, v = q.astype(float), v.astype(float)
    order = np.argsort(vid, kind="stable")
    vid, v, exact_v = vid[order], v[order], exact_v[order]
    levels = [s for s in LEVELS if s <= q.shape[1]]
    vs, out = [_stats(v, s) for s in levels], ([], [], [])
    for a in range(0, len(q), TILE):
        part, ids, exact = q[a : a + TILE], qid[a : a + TILE], exact_q[a : a + TILE]
        alive = ids[:, None] != vid[None, :]
        floor, cols = np.full(len(part), -np.inf), np.arange(len(v))
        upper = np.where(alive, np.inf, -np.inf)
        for level, (vm, vd) in zip(levels, vs, strict=True):  # a level's bound is one product of means and deviations side by side
            bound = np.hstack(_stats(part, level)) @ np.hstack([vm[cols], vd[cols]]).T
            upper[:, cols] = np.minimum(upper[:, cols], bound)
            first = min(len(v), 4 * k)
            if first > k:
                some = np.argpartition(-upper, first - 1, axis=1)[:, :first]
                seed = np.where(alive[np.arange(len(part))[:, None], some], np.einsum("ijk,ik->ij", v[some], part), -np.inf)
                floor = np.maximum(floor, np.sort(seed, axis=1)[:, -k])
            slack = 1e-6 * (1 + np.abs(floor, where=np.isfinite(floor), out=np.zeros(len(floor)))) + 1e-9 * np.abs(bound).max(initial=0)
            alive &= upper >= (floor - slack)[:, None]
            upper[~alive] = -np.inf
            cols = np.flatnonzero(alive.any(axis=0))
        if not big and alive.mean() > DENSE:  # most pairs are left: their scores are had cheaper as one product
            scores = np.where(alive, part @ v.T, -np.inf)
            kth = -np.partition(-scores, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]
            alive &= scores >= kth[:, None]
        rows, cols = np.nonzero(alive)
        score = (exact[rows] * exact_v[cols]).sum(axis=1) if len(rows) else np.empty(0)
        score = np.array([int(x) for x in score], object) if big else score.astype(np.int64)
        best = np.lexsort((cols, -score, rows)) if not big else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -score[i], cols[i])), np.int64)
        rows, cols, score = rows[best], cols[best], score[best]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = rank < k
        for x, y in zip(out, (ids[rows[top]], vid[cols[top]], score[top]), strict=True):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def topk(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 64, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of floor(scale * x), ties to the smaller vec_id.

    ``vectors`` and ``queries`` have (vec_id, embedding). A row's own id is no candidate for it. Rows whose id or
    embedding is null, empty, or holds a null or non-finite component take no part; vectors of different lengths
    don't meet. A repeated vec_id counts once, with its largest embedding. Scores beyond a long raise an error.
    """

    def ready(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).cast("array<long>").alias("x"))
        return rows.groupBy("vec_id").agg(F.max("x").alias("x")).withColumn("dim", F.size("x"))

    v, q = ready(vectors), ready(queries)
    nv, nq = (max(1, -(-n // block)) for n in (vectors.count(), queries.count()))
    spot = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    v = v.withColumns({"vb": spot(nv), "qb": F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))})
    q = q.withColumns({"qb": spot(nq), "vb": F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))})

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = t["x"].combine_chunks()
        return t["vec_id"].to_numpy(), x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.empty((0, 0), np.int64)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            ids = (np.empty(0, np.int64),) * 3
        else:
            (qid, qx), (vid, vx) = matrix(left), matrix(right)
            ids = block_topk(qid, qx, vid, vx, k)
        return pa.table([pa.array(np.asarray(x).tolist(), pa.int64()) for x in ids], names=["query_id", "vec_id", "score"])

    keys = ["dim", "qb", "vb"]
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
