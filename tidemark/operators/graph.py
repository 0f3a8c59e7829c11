"""Neighbour graphs as edge tables (src, dst[, dist]): construction, pruning, search, deletes, merging, levels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.tables import written
from . import search

GRAPH_ROWS = 200_000
"""A graph of at most so many nodes is sent whole to the tasks that walk it; larger ones are built and walked shard by shard."""


def shard_count(points: DataFrame, shard_rows: int) -> int:
    return max(1, -(-points.count() // shard_rows))


def shard_of(c, shards: int):
    """The hash part of a node: building and walking deal nodes alike."""
    return F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")


def knn_graph(points: DataFrame, r: int) -> DataFrame:
    """Edges to the r nearest others: the exact candidate graph."""
    near = search.knn(points, points.select(F.col("vec_id").alias("query_id"), "embedding"), r, self_too=False)
    return near.select(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"), "dist")


def medoid(points: DataFrame) -> DataFrame:
    """vec_id, dist of the point nearest to the mean."""
    mean = points.select(F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"))
    center = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("center"))  # one row
    return points.join(F.broadcast(center)).select("vec_id", V.l2(F.col("embedding"), F.col("center")).alias("dist")).orderBy("dist", "vec_id").limit(1)


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges and their reversals, each once."""
    return edges.select("src", "dst", "dist").union(edges.select("dst", "src", "dist")).dropDuplicates(["src", "dst"])


def cap(edges: DataFrame, r: int) -> DataFrame:
    """At most r nearest edges a node; ties to the smaller id."""
    return edges.withColumn("rnk", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")).cast("long")).where(F.col("rnk") <= r)


def robust_prune(src: np.ndarray, ids: np.ndarray, x: np.ndarray, dist: np.ndarray, r: int, alpha: float) -> list[int]:
    """Indexes kept of one node's candidates: nearest first, each hides those that it is alpha times nearer to; alpha grows by 1.2."""
    order, kept = np.lexsort((ids, dist)), []
    factor, level = np.zeros(len(ids)), 1.0
    del src
    while level <= alpha and len(kept) < r:
        for i in order:
            if len(kept) >= r:
                break
            if factor[i] > level or i in kept:
                continue
            kept.append(int(i))
            d = ((x - x[i]) ** 2).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(d > 0, dist / d, np.inf)
            later = np.ones(len(ids), bool)
            later[kept] = False
            factor[later] = np.maximum(factor[later], ratio[later])
        level *= 1.2
    return kept


def prune(candidates: DataFrame, points: DataFrame, r: int, alpha: float = 1.2) -> DataFrame:
    """Robustly pruned edges of candidate edges (src, dst, dist); callers see to it that a node's candidates are few."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("dst")
        kept = robust_prune(rows["src"].to_numpy(), rows["dst"].to_numpy(), np.stack(rows["x"].to_numpy()), rows["dist"].to_numpy(), r, alpha)
        return rows.iloc[kept][["src", "dst", "dist"]]

    full = candidates.join(points.select(F.col("vec_id").alias("dst"), V.doubles(F.col("embedding")).alias("x")), "dst")
    return full.select("src", "dst", "dist", "x").groupBy("src").applyInPandas(one, "src long, dst long, dist double")


def build(points: DataFrame, r: int = 16, candidates: int = 48, alpha: float = 1.2, shard_rows: int = GRAPH_ROWS) -> DataFrame:
    """A pruned graph: exact candidates, robust prune, reversed edges, and a prune of each node's 4 * r nearest of both.

    Beyond ``shard_rows`` points each shard that ``walk`` searches gets a whole graph of its own points.
    """
    shards = shard_count(points, shard_rows)
    parts = [points.where(shard_of("vec_id", shards) == s) for s in range(shards)] if shards > 1 else [points]
    near = reduce(DataFrame.union, [knn_graph(p, candidates) for p in parts])
    # a hub may be the neighbour of very many nodes: of those that point to it the nearest are its candidates
    return prune(cap(with_reverse(prune(near, points, r, alpha)), 4 * r).drop("rnk"), points, r, alpha)


def greedy_search(x: np.ndarray, neighbors: list[np.ndarray], start: int, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-first walk that keeps the ``width`` nearest seen nodes: (nodes, distances, visited)."""
    pool = {start: float(((x[start] - q) ** 2).sum())}
    done: set[int] = set()
    while open_nodes := [n for n in pool if n not in done]:
        best = min(open_nodes, key=lambda n: (pool[n], n))
        done.add(best)
        new = [n for n in neighbors[best].tolist() if n not in pool and n not in done]
        if new:
            pool.update(zip(new, ((x[new] - q) ** 2).sum(1).tolist(), strict=True))
            if len(pool) > width:
                pool = dict(sorted(pool.items(), key=lambda e: (e[1], e[0]))[:width])
    best = sorted(pool.items(), key=lambda e: (e[1], e[0]))
    return np.array([n for n, _ in best]), np.array([d for _, d in best]), len(done)


def walk(points: DataFrame, edges: DataFrame, queries: DataFrame, k: int, width: int = 64, shard_rows: int = GRAPH_ROWS) -> DataFrame:
    """query_id, rnk, neighbor_id, dist by greedy search of each shard's graph from its medoid, merged over shards.

    Shards are hash parts of at most about ``shard_rows`` nodes; a cogroup holds one shard's graph and a block of queries.
    ``edges`` are of a ``build`` of the same points with the same ``shard_rows``.
    """
    shards = shard_count(points, shard_rows)
    part = lambda c: shard_of(c, shards)
    lists = edges.where(part("src") == part("dst")).groupBy(F.col("src").alias("vec_id")).agg(F.collect_list("dst").alias("nbrs"))
    nodes = points.select("vec_id", V.doubles(F.col("embedding")).alias("x")).join(lists, "vec_id", "left").withColumn("s", part("vec_id"))
    asked = queries.select("query_id", V.doubles(F.col("embedding")).alias("q")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "neighbor_id": [], "dist": []})
        right = right.sort_values("vec_id")
        ids, x = right["vec_id"].to_numpy(), np.stack(right["x"].to_numpy())
        place = {v: i for i, v in enumerate(ids.tolist())}
        nbrs = [np.array([place[n] for n in (row if row is not None else []) if n in place], int) for row in right["nbrs"]]
        start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        rows = []
        for qid, q in zip(left["query_id"], left["q"], strict=True):
            nodes_, dist, _ = greedy_search(x, nbrs, start, np.asarray(q), max(width, k))
            rows += [(qid, ids[n], d) for n, d in zip(nodes_[:k], dist[:k], strict=True)]
        return pd.DataFrame(rows, columns=["query_id", "neighbor_id", "dist"])

    found = asked.groupBy("s").cogroup(nodes.groupBy("s")).applyInPandas(run, "query_id long, neighbor_id long, dist double")
    return search.rank(found, k).select("query_id", "rnk", "neighbor_id", "dist")


def insert(points: DataFrame, edges: DataFrame, new: DataFrame, r: int = 16, width: int = 64, alpha: float = 1.2, shard_rows: int = GRAPH_ROWS) -> DataFrame:
    """Edges after ``new`` points (vec_id, embedding) joined the graph of ``points``: a set at a time, in one round.

    A new point's candidates are what a greedy search for it meets, and the other new points nearest to it; they are
    pruned, and every neighbour that is kept gets the edge back. Only nodes that got one are pruned again.
    """
    asked = new.select(F.col("vec_id").alias("query_id"), "embedding")
    met = walk(points, edges, asked, width, width, shard_rows).select(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"), "dist")
    both = points.select("vec_id", V.doubles(F.col("embedding")).alias("embedding")).unionByName(new.select("vec_id", V.doubles(F.col("embedding")).alias("embedding")))
    fresh = written(prune(met.unionByName(knn_graph(new, r)).dropDuplicates(["src", "dst"]), both, r, alpha), "graph-new")
    back = fresh.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    touched = back.select("src").distinct()
    grown = edges.select("src", "dst", "dist").join(touched, "src", "left_semi").unionByName(fresh.join(touched, "src", "left_semi")).unionByName(back)
    untouched = edges.select("src", "dst", "dist").unionByName(fresh).join(touched, "src", "left_anti")
    return untouched.unionByName(prune(cap(grown.dropDuplicates(["src", "dst"]), 4 * r).drop("rnk"), both, r, alpha))


def erase(points: DataFrame, edges: DataFrame, deleted: DataFrame, r: int = 16, alpha: float = 1.2) -> DataFrame:
    """Edges after ``deleted`` (vec_id) left for good: who lost a neighbour takes over that one's neighbours and is pruned; all others stay as they are."""
    gone = deleted.select(F.col("vec_id").alias("g"))
    own = edges.select("src", "dst", "dist").join(gone, F.col("src") == F.col("g"), "left_anti")
    broken = own.join(gone, F.col("dst") == F.col("g"), "left_semi").select("src").distinct()
    near = consolidate(edges.select("src", "dst"), deleted, points).join(broken, "src", "left_semi")
    x = points.select("vec_id", V.doubles(F.col("embedding")).alias("x"))
    full = near.join(x.toDF("src", "a"), "src").join(x.toDF("dst", "b"), "dst").select("src", "dst", V.l2(F.col("a"), F.col("b")).alias("dist"))
    return own.join(broken, "src", "left_anti").unionByName(prune(cap(full, 4 * r).drop("rnk"), points, r, alpha))


def save(points: DataFrame, edges: DataFrame, path: str) -> None:
    """The index as two tables below ``path``."""
    points.select("vec_id", "embedding").write.mode("overwrite").parquet(f"{path}/points")
    edges.select("src", "dst", "dist").write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, edges) of a stored index; raises if an edge leads to a point that isn't there."""
    points, edges = spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/edges")
    ends = edges.select(F.col("src").alias("vec_id")).union(edges.select("dst")).distinct()
    if not ends.join(points.select("vec_id"), "vec_id", "left_anti").isEmpty():
        raise ValueError(f"{path} has edges to points that it lacks")
    return points, edges


def degree_stats(edges: DataFrame) -> DataFrame:
    """One row: max_degree, avg_degree, min_degree, below_two."""
    return edges.groupBy("src").agg(F.count("*").alias("d")).agg(F.max("d").alias("max_degree"), F.avg("d").alias("avg_degree"), F.min("d").alias("min_degree"), F.count_if(F.col("d") < 2).alias("below_two"))


def consolidate(edges: DataFrame, deleted: DataFrame, points: DataFrame, r: int | None = None) -> DataFrame:
    """Edges of live nodes after a delete: a deleted neighbour is replaced by its own live neighbours; capped at r if given."""
    gone = deleted.select(F.col("vec_id").alias("g"))
    live = edges.join(gone, F.col("src") == F.col("g"), "left_anti")
    kept = live.join(gone, F.col("dst") == F.col("g"), "left_anti").select("src", "dst")
    broken = live.join(gone, F.col("dst") == F.col("g"), "left_semi").select("src", F.col("dst").alias("via"))
    second = edges.join(gone, F.col("src") == F.col("g"), "left_semi").select(F.col("src").alias("via"), "dst").join(gone, F.col("dst") == F.col("g"), "left_anti")
    pairs = kept.union(broken.join(second, "via").select("src", "dst")).where("src <> dst").distinct()
    if r is None:
        return pairs
    ends = pairs.join(points.select(F.col("vec_id").alias("src"), F.col("embedding").alias("a")), "src").join(points.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("b")), "dst")
    return cap(ends.select("src", "dst", V.l2(F.col("a"), F.col("b")).alias("dist")), r)


def merge_shards(parts: DataFrame, r: int) -> DataFrame:
    """Union of the shards' neighbour lists, each edge once, nearest r kept."""
    return cap(parts.groupBy("src", "dst").agg(F.min("dist").alias("dist")), r)


def levels(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """node, level: breadth-first levels from ``starts`` (node), up to ``most``; the seen nodes are checkpointed each round."""
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        from ..sources.tables import shared_dir

        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    seen = starts.select("node", F.lit(0).cast("long").alias("level")).checkpoint()
    for level in range(1, most + 1):
        front = seen.where(F.col("level") == level - 1)
        new = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        grown = seen.unionByName(new.withColumn("level", F.lit(level).cast("long"))).checkpoint()
        if grown.count() == seen.count():
            break
        seen = grown
    return seen


def compact_ids(ids: DataFrame, buckets: int = 256) -> DataFrame:
    """vec_id, new_id: dense numbers from 0 in id order, without a global sort: counts before a range plus place in it."""
    bounds = ids.agg(F.min("vec_id"), F.max("vec_id")).first()
    if bounds[0] is None:
        return ids.select("vec_id", F.col("vec_id").alias("new_id"))
    width = (bounds[1] - bounds[0]) // buckets + 1
    rows = ids.select("vec_id", F.floor((F.col("vec_id") - bounds[0]) / width).alias("b"))
    before = rows.groupBy("b").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("b")) - F.col("n"))  # at most ``buckets`` rows
    place = F.row_number().over(Window.partitionBy("b").orderBy("vec_id"))
    return rows.withColumn("p", place).join(F.broadcast(before), "b").select("vec_id", (F.col("before") + F.col("p") - 1).cast("long").alias("new_id"))


def recycle_ids(new: DataFrame, free: DataFrame, next_id: int) -> DataFrame:
    """vec_id, slot: new rows take the free slots in order, then numbers from ``next_id``."""
    a, b = compact_ids(new).toDF("vec_id", "i"), compact_ids(free).toDF("slot", "i")
    n = free.count()
    return a.join(b, "i", "left").select("vec_id", F.coalesce("slot", F.lit(next_id) + F.col("i") - n).alias("slot"))


def compact(base: DataFrame, delta: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The rows that a merge writes: of each id the newest by seq of base and delta, unless a later tombstone deletes it."""
    rows = base.withColumn("seq", F.lit(0).cast("long")).unionByName(delta)
    newest = rows.groupBy("vec_id").agg(F.max(F.struct("seq", "embedding")).alias("m")).select("vec_id", "m.seq", "m.embedding")
    last = tombstones.groupBy("vec_id").agg(F.max("seq").alias("gone"))
    return newest.join(last, "vec_id", "left").where("gone is null or gone < seq").select("vec_id", "seq", "embedding")
