"""The result-list cache: entries of neighbour lists, exact and approximate hits, aliases, thresholds, the write log.

Where the threshold and risk rules aren't published they are defined here: an entry starts with the gap between
its farthest and nearest neighbour; an exact hit loosens, an approximate hit tightens. The risk of an entry that
hasn't seen the newest writes is the share of its own distance spread, (max - min) / max, for each of them; the
slow path has to run when the mean risk over all entries is more than is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.tables import written
from . import search

LOOSEN, TIGHTEN = 1.10, 0.25


def entries(answers: DataFrame, in_topk: int, slack: int) -> DataFrame:
    """query_id, neighbors (array of struct(rnk, id, dist)), min_d, max_d: in_topk + slack neighbours each."""
    rows = answers.where(F.col("rnk") <= in_topk + slack)
    lists = F.array_sort(F.collect_list(F.struct("rnk", F.col("neighbor_id").alias("id"), "dist")))
    return rows.groupBy("query_id").agg(lists.alias("neighbors"), F.min("dist").alias("min_d"), F.max("dist").alias("max_d"))


def exact_hits(queries: DataFrame) -> DataFrame:
    """query_seq, first_seq, hit: whether an equal vector came before; the first one's entry answers.

    Vectors are compared by 128 bits of hashes; minima are taken before the shuffle, so a vector asked over and over is one row a task.
    """
    marked = queries.select("query_seq", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    first = marked.groupBy("h1", "h2").agg(F.min("query_seq").alias("first_seq"))
    return marked.join(first, ["h1", "h2"]).select("query_seq", "first_seq", (F.col("first_seq") < F.col("query_seq")).alias("hit"))


def approximate_hits(queries: DataFrame, representatives: DataFrame, threshold: float) -> DataFrame:
    """query_id, neighbor_id, dist, hit: the nearest representative, a hit within the threshold."""
    near = search.knn(representatives, queries, 1)
    return near.select("query_id", "neighbor_id", "dist", (F.col("dist") < threshold).alias("hit"))


def alias_roots(links: DataFrame) -> DataFrame:
    """query_id, root of parent links (query_id, parent_id; null at a root), by doubling the links until none moves; links must have no circle.

    Each round is written to the shared folder, so a plan is one round long; there are as many as doublings of the longest chain.
    """
    at = written(links.select("query_id", F.coalesce("parent_id", "query_id").alias("root")), "alias-links")
    while True:
        up = at.select(F.col("query_id").alias("root"), F.col("root").alias("r"))
        moved = written(at.join(up, "root", "left").select("query_id", F.coalesce("r", "root").alias("root"), (F.coalesce("r", "root") != F.col("root")).alias("moved")), "alias-links")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def validate(entry_rows: DataFrame, dead: Column, k: int) -> DataFrame:
    """Entries (query_id, neighbors) with invalid neighbours at the tail and ``valid``: whether k valid ones are left."""
    good = F.filter("neighbors", lambda n: ~F.coalesce(F.array_contains(dead, n["id"]), F.lit(False)))
    bad = F.filter("neighbors", lambda n: F.coalesce(F.array_contains(dead, n["id"]), F.lit(False)))
    return entry_rows.withColumns({"n_valid": F.size(good).cast("long"), "neighbors": F.concat(good, bad)}).withColumn("valid", F.col("n_valid") >= k)


def adapt(hits: DataFrame, start: Column) -> DataFrame:
    """query_id, thresh after its hits in order: exact ones loosen, approximate ones tighten. hits: (query_id, seq, kind)."""
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind"))), lambda s: s["kind"])
    return hits.groupBy("query_id").agg(kinds.alias("k")).select("query_id", F.aggregate("k", start, lambda t, x: F.when(x == "exact", t * LOOSEN).when(x == "approx", t * TIGHTEN).otherwise(t)).alias("thresh"))


def references(entry_rows: DataFrame, pool: DataFrame) -> DataFrame:
    """vec_id, refs of all pooled vectors: in how many entries each stands; 0 may go."""
    used = entry_rows.select(F.explode("neighbors").alias("n")).groupBy(F.col("n.id").alias("vec_id")).agg(F.count("*").alias("refs"))
    return pool.select("vec_id").join(used, "vec_id", "left").select("vec_id", F.coalesce("refs", F.lit(0)).cast("long").alias("refs"))


def scan_log(entry_rows: DataFrame, log: DataFrame, window: int) -> DataFrame:
    """query_id, vec_id, epoch, dist of logged vectors after an entry's checkpoint, within ``window`` epochs, nearer than its farthest.

    The range join is by equality of epoch buckets of the window's size: an entry looks in two of them.
    """
    logged = log.withColumn("b", F.floor(F.col("epoch") / window))
    looks = entry_rows.withColumn("b", F.explode(F.array(F.floor((F.col("checkpoint") + 1) / window), F.floor((F.col("checkpoint") + window) / window)))).dropDuplicates(["query_id", "b"])
    met = looks.select("query_id", "checkpoint", "max_d", F.col("embedding").alias("q"), "b").join(logged, "b").where(F.col("epoch").between(F.col("checkpoint") + 1, F.col("checkpoint") + window))
    return met.withColumn("dist", V.l2(F.col("q"), F.col("embedding"))).where("dist < max_d").select("query_id", "vec_id", "epoch", "dist")


def refresh(answers: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """New top k of entries (query_id, neighbor_id, dist) with the log's candidates merged in."""
    both = answers.select("query_id", "neighbor_id", "dist").union(candidates.select("query_id", F.col("vec_id").alias("neighbor_id"), "dist"))
    return search.rank(both.groupBy("query_id", "neighbor_id").agg(F.min("dist").alias("dist")), k)


def trim_log(log: DataFrame, entry_rows: DataFrame) -> DataFrame:
    """One row: unseen (sum over entries of epochs after their checkpoint), trim_to (the least checkpoint)."""
    tail = log.agg(F.max("epoch").alias("tail"))  # one row
    return entry_rows.join(F.broadcast(tail)).agg(F.sum(F.col("tail") - F.col("checkpoint")).alias("unseen"), F.min("checkpoint").alias("trim_to"))


def risk(entry_rows: DataFrame, tail: int, allowed: float) -> DataFrame:
    """One row: entries, unseen (epochs after their checkpoints, summed), avg_risk, must_refresh. entry_rows: (checkpoint, min_d, max_d)."""
    unseen = F.greatest(F.lit(0), F.lit(tail) - F.col("checkpoint"))
    factor = F.when(F.col("max_d") > 0, (F.col("max_d") - F.col("min_d")) / F.col("max_d")).otherwise(0.0)
    out = entry_rows.agg(F.count("*").alias("entries"), F.coalesce(F.sum(unseen), F.lit(0)).alias("unseen"), F.coalesce(F.avg(factor * unseen), F.lit(0.0)).alias("avg_risk"))
    return out.withColumn("must_refresh", F.col("avg_risk") > allowed)


def round_robin(entry_rows: DataFrame, cursor: int, n: int) -> DataFrame:
    """The next ``n`` entries after ``cursor`` by query_id, from the smallest on again after the last: what one slow-path sweep refreshes."""
    ids = entry_rows.select("query_id", (F.col("query_id") <= cursor).alias("wrapped"))
    return ids.orderBy("wrapped", "query_id").limit(n).select("query_id", "wrapped")


def invalidate_random(entry_rows: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """``entry_rows`` (query_id, ..) with ``invalid`` for about ``percent`` of them, the same ones at each run: a stress test of refills."""
    draw = F.pmod((F.col("query_id") + 1) * 48271 + seed * 69621, F.lit(2147483647).cast("long"))
    return entry_rows.withColumn("invalid", draw < F.lit(int(percent / 100 * 2147483647)))
