"""Clustering and product quantisation: k-means steps and loop, codebooks, codes, look-up distances."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.tables import written
from . import search

CODEBOOK_ROWS = 65_536
"""Codebooks and centre tables of at most so many rows are broadcast."""


ADC_BLOCK = 2048
"""Look-up distances are added up for so many queries and codes at a time."""


SAMPLE_ROWS = 65_536
"""Centres, codebooks and seeds are learned from at most so many rows, those with the smallest hashes of their id."""


def bounded(points: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``points``, or ``rows`` of them drawn by hash without replacement."""
    return points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows)


def small(table: DataFrame) -> DataFrame:
    """``table`` marked for broadcast if it is proven small."""
    return F.broadcast(table) if table.limit(CODEBOOK_ROWS + 1).count() <= CODEBOOK_ROWS else table


def means(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """center_id, dim, mean of the points assigned to each centre: a partial sum per dimension."""
    return assigned.join(points, "vec_id").select("center_id", F.posexplode("embedding").alias("dim", "x")).groupBy("center_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def collect_vectors(long: DataFrame, key: str = "center_id") -> DataFrame:
    """(key, embedding) of (key, dim, mean)."""
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("embedding"))


def lloyd(points: DataFrame, centers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One iteration: (new centres as center_id, dim, mean; assignment)."""
    assigned = search.closest_centers(points, centers, 1)
    return means(points.select("vec_id", "embedding"), assigned), assigned


def kmeans(points: DataFrame, k: int, iterations: int = 15, tolerance: float = 1e-5) -> DataFrame:
    """center_id, embedding after at most ``iterations`` rounds from k pivots chosen by hash; stops when the residual settles.

    The centres are k rows; only they and one residual a round reach the driver.
    """
    rows = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).collect()
    spark, before = points.sparkSession, None
    centers = [(i, [float(x) for x in r.embedding]) for i, r in enumerate(rows)]
    frame = lambda: spark.createDataFrame(centers, "center_id long, embedding array<double>")
    for _ in range(iterations):
        new, assigned = lloyd(points, frame())
        residual = assigned.agg(F.sum("dist")).first()[0] or 0.0
        moved = {r.center_id: list(r.embedding) for r in collect_vectors(new).collect()}
        centers = [(i, moved.get(i, v)) for i, v in centers]
        if before is not None and (before == 0 or (before - residual) / before < tolerance):
            break
        before = residual
    return frame()


def seeds_by_distance(points: DataFrame, k: int, seed: int = 0, rows: int = SAMPLE_ROWS) -> DataFrame:
    """k-means++ pivots (center_id, embedding): each next one drawn in proportion to the squared distance to the nearest so far, from a sample of at most ``rows``."""
    sample = bounded(points, rows).select("vec_id", V.doubles(F.col("embedding")).alias("x")).toPandas()
    rng, x = np.random.default_rng(seed), np.stack(sample["x"].to_numpy())
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        weight = near if near.sum() > 0 else np.where(np.isin(np.arange(len(x)), chosen), 0.0, 1.0)
        chosen.append(int(rng.choice(len(x), p=weight / weight.sum())))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return points.sparkSession.createDataFrame([(i, x[c].tolist()) for i, c in enumerate(chosen)], "center_id long, embedding array<double>")


def estimate_sizes(sample: DataFrame, share: float, centers: DataFrame, copies: int = 1) -> DataFrame:
    """center_id, size: how many points of the whole table each centre would hold, by a sample of ``share`` of it."""
    near = search.closest_centers(sample, centers, copies)
    return near.groupBy("center_id").agg(F.round(F.count("*") / share).cast("long").alias("size"))


def parts_for_budget(points: DataFrame, row_bytes: int, budget_bytes: float, copies: int = 2, start: int = 3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Centres (center_id, embedding) of as few parts, ``start`` at least, as keep the largest part within a memory budget.

    Each point goes to its ``copies`` nearest parts. Sizes are estimated from a sample of at most ``rows``.
    """
    sample = written(bounded(points, rows), "budget-sample")
    total, held = points.count(), sample.count()
    share = held / max(1, total)
    parts = start
    while True:
        centers = kmeans(sample, parts, 5)
        largest = estimate_sizes(sample, share, centers, min(copies, parts)).agg(F.max("size")).first()[0] or 0
        if largest * row_bytes <= budget_bytes:
            return centers
        if parts >= held:
            raise ValueError("no split into parts fits the budget")
        parts += 1


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotate(points: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """vec_id, embedding turned by a random rotation: distances stay as they are. The matrix is one folded constant."""
    matrix = F.from_json(F.lit(json.dumps(rotation(dim, seed).tolist())), "array<array<double>>")
    return points.select("vec_id", F.transform(matrix, lambda row: V.dot(row, F.col("embedding"))).alias("embedding"))


def chunks(dim: int, n: int) -> list[tuple[int, int]]:
    """Balanced (from, to) ranges of dimensions."""
    edges = [round(i * dim / n) for i in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def chunk_count(budget_bytes: float, points: int, dim: int, most: int = 100) -> int:
    """PQ chunks that a memory budget allows: one byte a point and chunk."""
    return max(1, min(dim, most, int(budget_bytes // max(1, points))))


def split(points: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """vec_id, chunk, part: each vector's sub-vectors."""
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("chunk"), F.slice(V.doubles(F.col("embedding")), a + 1, b - a).alias("part")) for i, (a, b) in enumerate(ranges)])
    return points.select("vec_id", F.explode(parts).alias("p")).select("vec_id", "p.chunk", "p.part")


def train_pq(points: DataFrame, ranges: list[tuple[int, int]], codes: int = 256, iterations: int = 15, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Codebook (chunk, code, part): Lloyd's rounds of each chunk in one task, on a sample of at most ``rows``."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        x = np.stack(rows["part"].to_numpy())
        centers = x[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)].copy()
        for _ in range(iterations):
            near = ((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None, :]).argmin(1)
            for c in np.unique(near):
                centers[c] = x[near == c].mean(0)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[0], "code": range(len(centers)), "part": list(centers)})

    return split(bounded(points, rows), ranges).groupBy("chunk").applyInPandas(fit, "chunk long, code long, part array<double>")


def encode(points: DataFrame, codebook: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """vec_id, chunk, code, d: each sub-vector's nearest code, ties to the smaller code."""
    pairs = split(points, ranges).join(small(codebook.withColumnRenamed("part", "center")), "chunk")
    scored = pairs.withColumn("d", V.l2(F.col("part"), F.col("center")))
    return scored.groupBy("vec_id", "chunk").agg(F.min(F.struct("d", "code")).alias("m")).select("vec_id", "chunk", "m.code", "m.d")


def decode(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """vec_id, embedding rebuilt from its codes."""
    parts = codes.join(small(codebook), ["chunk", "code"])
    return parts.groupBy("vec_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda s: s["part"])).alias("embedding"))


def lookup(queries: DataFrame, codebook: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """query_id, chunk, code, d: each query's distance to each code of each chunk."""
    parts = split(queries.select(F.col("query_id").alias("vec_id"), "embedding"), ranges)
    return parts.join(small(codebook.withColumnRenamed("part", "center")), "chunk").select(F.col("vec_id").alias("query_id"), "chunk", "code", V.l2(F.col("part"), F.col("center")).alias("d"))


def adc(queries: DataFrame, codes: DataFrame, codebook: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """query_id, neighbor_id, dist of all pairs by look-up tables: the sum over chunks of query part to code distances."""
    table = lookup(queries, codebook, ranges)
    return codes.select(F.col("vec_id").alias("neighbor_id"), "chunk", "code").join(table, ["chunk", "code"]).groupBy("query_id", "neighbor_id").agg(F.sum("d").alias("dist"))


def adc_nearest(queries: DataFrame, codes: DataFrame, points: int, codebook: DataFrame, ranges: list[tuple[int, int]], k: int, digits: int = 9, block: int = ADC_BLOCK) -> DataFrame:
    """query_id, rnk, neighbor_id, dist: the k least look-up distances of each query, rounded to ``digits`` before they are ordered.

    What ``adc`` has as rows of all pairs is added up here in blocks of ``points`` codes (how many are coded) and queries.
    """
    tables = lookup(queries, codebook, ranges).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "code", "d"))).alias("t"))
    q = tables.select("query_id", "t.chunk", "t.code", "t.d")
    b = codes.where("vec_id is not null").groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "code"))).alias("c")).select("vec_id", "c.chunk", "c.code")
    lists = lambda t, name: t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")
            chunk, code, d = lists(left, "chunk")[0], lists(left, "code")[0], np.nan_to_num(lists(left, "d").astype(float), nan=np.inf, posinf=np.inf)
            dist = np.zeros((left.num_rows, right.num_rows))
            for c, own in zip(*(lists(right, name).T for name in ("chunk", "code")), strict=True):
                first = np.searchsorted(chunk, c[0])
                dist += d[:, first + np.searchsorted(code[chunk == c[0]], own)]
            dist = np.floor(dist * 10**digits + 0.5) / 10**digits
            kth = np.partition(dist, min(k, dist.shape[1]) - 1, axis=1)[:, min(k, dist.shape[1]) - 1]
            rows, cols = np.nonzero(dist <= kth[:, None])
            best = np.lexsort((cols, dist[rows, cols], rows))
            rows, cols = rows[best], cols[best]
            top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, cols = rows[top], cols[top]
            found = (left["query_id"].to_numpy()[rows], right["vec_id"].to_numpy()[cols], dist[rows, cols])
        return pa.table([pa.array(x) for x in found], names=["query_id", "neighbor_id", "dist"])

    nb, nq = max(1, -(-points // block)), search.block_count(queries, block)
    return search.rank(search.dealt(b, q, nb, nq).applyInArrow(meet, "query_id long, neighbor_id long, dist double"), k)


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The k best of ``candidates`` (query_id, neighbor_id) by exact distance."""
    full = candidates.select("query_id", "neighbor_id").join(base.select(F.col("vec_id").alias("neighbor_id"), F.col("embedding").alias("b")), "neighbor_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    return search.rank(full.select("query_id", "neighbor_id", V.distance(metric, F.col("q"), F.col("b")).alias("dist")), k)


def random_slice(points: DataFrame, share: float) -> DataFrame:
    """A repeatable Bernoulli sample by hash of the id."""
    return points.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def pca(points: DataFrame, dims: int) -> DataFrame:
    """One row (mean, components, lo, hi): a principal basis from distributed second moments, and the range along it."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = points.select(array_to_vector(V.doubles(F.col("embedding"))).alias("v"))
    model = PCA(k=dims, inputCol="v", outputCol="p").fit(rows)
    long = model.transform(rows).select(F.posexplode(vector_to_array("p")).alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("dim").collect()
    mean = points.select(F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m")).orderBy("dim").collect()
    row = ([r.m for r in mean], model.pc.toArray().T.tolist(), [r.lo for r in long], [r.hi for r in long])
    return points.sparkSession.createDataFrame([row], "mean array<double>, components array<array<double>>, lo array<double>, hi array<double>")


def save_pca(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_pca(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """A stored model; raises if it isn't one row whose basis fits vectors of ``dim`` components."""
    model = spark.read.parquet(path)
    rows = model.select(F.size("mean").alias("mean"), F.size("components").alias("n"), F.size("lo").alias("lo"), F.size("hi").alias("hi"), F.forall("components", lambda c: F.size(c) == dim).alias("fits")).limit(2).collect()
    if len(rows) != 1 or rows[0].mean != dim or not rows[0].fits or not rows[0].n == rows[0].lo == rows[0].hi:
        raise ValueError(f"{path} holds no basis for {dim} components")
    return model


def project(points: DataFrame, model: DataFrame, buckets: int) -> DataFrame:
    """vec_id, region: the bucket of each vector along each component of a PCA model, between the range that was learned.

    The model may come from the base or from a sample of queries: ``pca`` takes either.
    """
    along = F.zip_with(F.transform("components", lambda c: V.dot(c, F.col("embedding"))), F.arrays_zip("lo", "hi"), lambda x, r: F.when(r["hi"] == r["lo"], 0).otherwise(F.least(F.lit(buckets - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - r["lo"]) / (r["hi"] - r["lo"]))) * buckets))).cast("int"))
    return points.join(F.broadcast(model.limit(1))).select("vec_id", along.alias("region"))
