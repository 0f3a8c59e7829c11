"""Exact and two-stage nearest-neighbour search, merging of results, look-ups by id.

The exact search never forms all pairs as rows: vectors and queries are dealt into blocks, a pair of blocks is
one matrix product in one task, and only its k best rows per query leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from ..functions import vectors as V

BLOCK = 8192
PAIR_BLOCK = 1024
"""Block of what returns all pairs: a pair of blocks is a table of the square of that in one task."""


def rank(rows: DataFrame, k: int | Column, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k nearest rows of each query, in the total order (dist, neighbor_id), with ``rnk`` from 1."""
    order = Window.partitionBy(*by).orderBy("dist", "neighbor_id")
    return rows.withColumn("rnk", F.row_number().over(order).cast("long")).where(F.col("rnk") <= k)


def _block_topk(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, metric: str, self_too: bool) -> tuple[np.ndarray, ...]:
    product = q @ v.T
    if metric == "l2":
        rough = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * product
    elif metric == "ip":
        rough = -product
    else:
        norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
        rough = np.where(norms == 0, 3.4028234663852886e38, 1 - product / np.where(norms == 0, 1, norms))
    if not self_too:
        rough[qid[:, None] == vid[None, :]] = np.inf
    # all that may be among the k best once distances are exact and ties are ordered by id
    kth = np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1]
    rows, cols = np.nonzero((rough <= (kth + 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0))))[:, None]) & np.isfinite(rough))
    if metric == "l2":
        d = ((q[rows] - v[cols]) ** 2).sum(1)
    else:
        d = rough[rows, cols]
    best = np.lexsort((vid[cols], d, rows))
    rows, cols, d = rows[best], cols[best], d[best]
    top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return qid[rows[top]], vid[cols[top]], d[top]


def block_count(rows: DataFrame, block: int) -> int:
    return max(1, -(-rows.count() // block))


def dealt(base: DataFrame, queries: DataFrame, nb: int, nq: int) -> PandasCogroupedOps:
    """``queries`` (query_id, ...) cogrouped with ``base`` (vec_id, ...), in nq and nb blocks: each query meets each row in just one group."""
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    b = base.withColumns({"vb": spot("vec_id", nb), "qb": F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))})
    q = queries.withColumns({"qb": spot("query_id", nq), "vb": F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))})
    return q.groupBy("qb", "vb").cogroup(b.groupBy("qb", "vb"))


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", self_too: bool = True, block: int = BLOCK, shard: Column | None = None) -> DataFrame:
    """query_id, rnk, neighbor_id, dist of the k nearest of ``base`` (vec_id, embedding) to ``queries`` (query_id, embedding).

    With ``shard``, an expression over ``base``, the k nearest of each shard, and shard_id, in the same one pass.
    """
    V.distance(metric, F.lit(None), F.lit(None)) if metric not in V.METRICS else None
    nb, nq = block_count(base, block), block_count(queries, block)
    own = (shard if shard is not None else F.lit(0)).cast("long").alias("shard_id")
    b = base.select("vec_id", V.doubles(F.col("embedding")).alias("x"), own)
    q = queries.select("query_id", V.doubles(F.col("embedding")).alias("x"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        if left.num_rows and right.num_rows:
            (qid, qx), (vid, vx) = ((t.column(0).to_numpy(), t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)) for t in (left, right))
            held = right["shard_id"].to_numpy()
            for s in np.unique(held):
                best = _block_topk(qid, qx, vid[held == s], vx[held == s], k, metric, self_too)
                found.append((*best, np.full(len(best[0]), s)))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "neighbor_id", "dist", "shard_id"])

    pairs = dealt(b, q, nb, nq).applyInArrow(meet, "query_id long, neighbor_id long, dist double, shard_id long")
    if shard is None:
        return rank(pairs, k).select("query_id", "rnk", "neighbor_id", "dist")
    return rank(pairs, k, ("query_id", "shard_id")).select("query_id", "shard_id", "rnk", "neighbor_id", "dist")


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length; vectors that are null or hold a null are left out."""
    x = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False).copy()
    length[pc.list_parent_indices(x).filter(x.flatten().is_null()).to_numpy()] = -1
    return {int(n): (np.flatnonzero(length == n), x.filter(pa.array(length == n)).flatten().to_numpy().reshape(-1, n) if n else np.empty((np.sum(length == 0), 0))) for n in np.unique(length) if n >= 0}


def all_pairs(base: DataFrame, queries: DataFrame, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = PAIR_BLOCK) -> DataFrame:
    """query_id, neighbor_id, dist of each query (query_id, embedding) with each row of ``base`` (vec_id, embedding), unrounded.

    ``distance`` takes a matrix of queries and one of vectors, as V.BLOCKWISE has them. The distance is null if a
    vector is null or holds a null, or if their lengths differ.
    """
    b = base.select("vec_id", V.doubles(F.col("embedding")).alias("x"))
    q = queries.select("query_id", V.doubles(F.col("embedding")).alias("x"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        dist, known = np.zeros((left.num_rows, right.num_rows)), np.zeros((left.num_rows, right.num_rows), bool)
        if left.num_rows and right.num_rows:
            vectors = _by_length(right["x"])
            for n, (i, qx) in _by_length(left["x"]).items():
                if n in vectors:
                    j, vx = vectors[n]
                    dist[np.ix_(i, j)], known[np.ix_(i, j)] = distance(qx, vx), True
        rows, cols = (pa.array(x) for x in (np.repeat(np.arange(left.num_rows), right.num_rows), np.tile(np.arange(right.num_rows), left.num_rows)))
        return pa.table([left["query_id"].combine_chunks().take(rows), right["vec_id"].combine_chunks().take(cols), pa.array(dist.ravel(), mask=~known.ravel())], names=["query_id", "neighbor_id", "dist"])

    return dealt(b, q, block_count(base, block), block_count(queries, block)).applyInArrow(meet, "query_id long, neighbor_id long, dist double")


def live(base: DataFrame, extras: DataFrame, deleted: DataFrame) -> DataFrame:
    """The live set: base and extras without what was deleted (vec_id)."""
    return base.unionByName(extras).join(deleted.select("vec_id"), "vec_id", "left_anti")


def knn_variable(base: DataFrame, queries: DataFrame, pool: list[int], metric: str = "l2") -> DataFrame:
    """Each query asks for its own k, taken from ``pool`` by its id."""
    own = F.element_at(F.array(*map(F.lit, pool)), (F.pmod("query_id", F.lit(len(pool))) + 1).cast("int"))
    return knn(base, queries, max(pool), metric).withColumn("k", own.cast("long")).where("rnk <= k")


def shard_topk(base: DataFrame, queries: DataFrame, shard: Column, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest of each shard for each query: query_id, shard_id, rnk, neighbor_id, dist."""
    return knn(base, queries, k, metric, shard=shard)


def first_hit(shard_results: DataFrame, order: DataFrame, k: int, threshold: Column) -> DataFrame:
    """Shards asked one after the other: each query's answer is that of the first shard, by ``order`` (shard_id, place), that holds k
    results whose farthest is within ``threshold`` (an expression over dist); queries that no shard answers fall back to the backend and have no row."""
    per = shard_results.groupBy("query_id", "shard_id").agg(F.count("*").alias("n"), F.max("dist").alias("dist")).where((F.col("n") >= k) & threshold)
    best = per.join(order, "shard_id").groupBy("query_id").agg(F.min(F.struct("place", "shard_id")).alias("s")).select("query_id", F.col("s.shard_id").alias("shard_id"))
    return shard_results.join(best, ["query_id", "shard_id"])


def merge_topk(hits: DataFrame, k: int) -> DataFrame:
    """Merged results of several sources (query_id, neighbor_id, dist, shard_id): each id once with its least distance."""
    once = hits.groupBy("query_id", "neighbor_id").agg(F.min(F.struct("dist", "shard_id")).alias("m"))
    return rank(once.select("query_id", "neighbor_id", "m.dist", "m.shard_id"), k)


def contributions(merged: DataFrame) -> DataFrame:
    """How many of a query's results each source gave; sources are touched from least to most."""
    return merged.groupBy("query_id", "shard_id").agg(F.count("*").alias("n"))


def fetch_by_ids(base: DataFrame, ids: DataFrame, missing: str = "null", dim: int | None = None) -> DataFrame:
    """Vectors of ``ids`` (seq, vec_id), in their order; a missing one is null, or zeros of length ``dim``."""
    found = ids.join(base.select("vec_id", "embedding"), "vec_id", "left")
    if missing == "zero":
        found = found.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dim)))
    return found


def closest_centers(points: DataFrame, centers: DataFrame, k: int = 1) -> DataFrame:
    """vec_id, rnk, center_id, dist of the k nearest centres (center_id, embedding) of each point."""
    near = knn(centers.select(F.col("center_id").alias("vec_id"), "embedding"), points.select(F.col("vec_id").alias("query_id"), "embedding"), k)
    return near.select(F.col("query_id").alias("vec_id"), "rnk", F.col("neighbor_id").alias("center_id"), "dist")


def pad(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Results with k rows for each query; what is missing has a null neighbour and distance."""
    slots = queries.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rnk"))
    return slots.join(results, ["query_id", "rnk"], "left")
