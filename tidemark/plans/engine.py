"""Search backends behind one interface, and the cached search over any of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import cache, graph, quantize, search
from ..sources.tables import written

Step = Callable[[DataFrame], DataFrame]


class Backend:
    """What a backend offers, a set of queries at a time; a class with ``search`` and ``fetch_by_ids`` is one.

    ``supports_updates`` says whether ``insert`` and ``remove`` are there; by default they raise.
    """

    supports_updates = False

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError

    def fetch_by_ids(self, ids: DataFrame) -> DataFrame:
        raise NotImplementedError

    def insert(self, rows: DataFrame) -> None:
        raise NotImplementedError(f"{type(self).__name__} takes no inserts")

    def remove(self, ids: DataFrame) -> None:
        raise NotImplementedError(f"{type(self).__name__} takes no deletes")


def answer(backend: Backend, queries: DataFrame, k: int, transform: Step | None = None, distance: Callable[[Column, Column], Column] | None = None, result: Step | None = None) -> DataFrame:
    """A search with steps of the caller's own: ``transform`` changes the queries before it, ``distance`` (an expression over two
    vectors) ranks what was found anew, ``result`` changes the rows that come back."""
    asked = transform(queries) if transform else queries
    found = backend.search(asked, k)
    if distance:
        full = backend.fetch_by_ids(found.select("query_id", F.col("neighbor_id").alias("vec_id"))).select("query_id", F.col("vec_id").alias("neighbor_id"), F.col("embedding").alias("b"))
        sides = full.join(asked.select("query_id", F.col("embedding").alias("a")), "query_id")
        found = search.rank(sides.select("query_id", "neighbor_id", distance(F.col("a"), F.col("b")).alias("dist")), k).select("query_id", "rnk", "neighbor_id", "dist")
    return result(found) if result else found


class Exact(Backend):
    """Brute force over the live rows: base and inserts without deletes."""

    supports_updates = True

    def __init__(self, base: DataFrame, metric: str = "l2"):
        self.rows, self.metric = base.select("vec_id", "embedding"), metric

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search.knn(self.rows, queries, k, self.metric)

    def fetch_by_ids(self, ids: DataFrame) -> DataFrame:
        return search.fetch_by_ids(self.rows, ids)

    def insert(self, rows: DataFrame) -> None:
        """Upserts: a row replaces the one of the same id."""
        self.rows = self.rows.join(rows.select("vec_id"), "vec_id", "left_anti").unionByName(rows.select("vec_id", "embedding"))

    def remove(self, ids: DataFrame) -> None:
        self.rows = self.rows.join(ids.select("vec_id"), "vec_id", "left_anti")


class Inverted(Backend):
    """Lists by nearest centre, product codes in them, exact distances for the best candidates."""

    def __init__(self, base: DataFrame, centers: int = 16, chunks: int = 8, probes: int = 4, widen: int = 10):
        self.base, self.probes, self.widen = base, probes, widen
        dim = len(base.first().embedding)
        self.ranges = quantize.chunks(dim, chunks)
        self.centers = quantize.kmeans(quantize.bounded(base), centers, 5)  # at most quantize.SAMPLE_ROWS
        self.book = quantize.train_pq(base, self.ranges, 64, 5)
        self.lists = search.closest_centers(base, self.centers, 1).select("vec_id", "center_id")
        self.codes = quantize.encode(base, self.book, self.ranges)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        probed = search.closest_centers(queries.select(F.col("query_id").alias("vec_id"), "embedding"), self.centers, self.probes).select(F.col("vec_id").alias("query_id"), "center_id")
        # codes of the probed lists only, each beside the look-up table of the queries that probe its list
        tables = quantize.lookup(queries, self.book, self.ranges)
        near = probed.join(self.lists, "center_id").select("query_id", "vec_id").join(self.codes.select("vec_id", "chunk", "code"), "vec_id")
        rough = near.join(tables, ["query_id", "chunk", "code"]).groupBy("query_id", F.col("vec_id").alias("neighbor_id")).agg(F.sum("d").alias("dist"))
        return quantize.rerank(search.rank(rough, k * self.widen), self.base, queries, k)

    def fetch_by_ids(self, ids: DataFrame) -> DataFrame:
        return search.fetch_by_ids(self.base, ids)


class Graph(Backend):
    """Greedy search of a pruned neighbour graph, which takes inserts and deletes a set at a time."""

    supports_updates = True

    def __init__(self, base: DataFrame, r: int = 16, width: int = 64, edges: DataFrame | None = None):
        self.base, self.r, self.width = base.select("vec_id", "embedding"), r, width
        self.edges = written(graph.build(base, r), "graph") if edges is None else edges

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return graph.walk(self.base, self.edges, queries, k, self.width)

    def fetch_by_ids(self, ids: DataFrame) -> DataFrame:
        return search.fetch_by_ids(self.base, ids)

    def insert(self, rows: DataFrame) -> None:
        """New ids only: an id that is there is removed first."""
        rows = written(rows.select("vec_id", "embedding"), "graph-inserts")
        known = rows.join(self.base, "vec_id", "left_semi").select("vec_id")
        if not known.isEmpty():
            self.remove(known)
        self.edges = written(graph.insert(self.base, self.edges, rows, self.r, self.width), "graph")
        self.base = written(self.base.unionByName(rows), "graph-points")

    def remove(self, ids: DataFrame) -> None:
        self.edges = written(graph.erase(self.base, self.edges, ids, self.r), "graph")
        self.base = written(self.base.join(ids.select("vec_id"), "vec_id", "left_anti"), "graph-points")

    def save(self, path: str) -> None:
        graph.save(self.base, self.edges, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, r: int = 16, width: int = 64) -> Graph:
        base, edges = graph.load(spark, path)
        return cls(base, r, width, edges)


class Cached:
    """The query-aware cache before a backend: ``replay`` answers a stream of queries in order."""

    def __init__(self, backend: Backend, base: DataFrame, config: cache.CacheConfig):
        self.backend, self.base, self.config = backend, base, config

    def replay(self, stream: DataFrame) -> DataFrame:
        """stream: (cache_id, query_seq, query_id, embedding); the backend answers all distinct queries at once."""
        asked = stream.select("query_id", "embedding").dropDuplicates(["query_id"])
        rows = stream.withColumn("k", F.lit(self.config.k)).withColumn("embedding", V.doubles(F.col("embedding")))
        return cache.replay(cache.with_answers(rows, self.backend.search(asked, self.config.k), self.base), self.config)
