"""Recall, latency and stream metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, matched, recall of result rows (query_id, neighbor_id) against the k nearest of truth (.., rnk)."""
    best = truth.where(F.col("rnk") <= k).select("query_id", "neighbor_id")
    met = best.join(results.select("query_id", "neighbor_id").distinct().withColumn("m", F.lit(1)), ["query_id", "neighbor_id"], "left")
    return met.groupBy("query_id").agg(F.count("m").alias("matched")).withColumn("recall", F.col("matched") / k)


def recall_tie_aware(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Recall that counts a result as right if it is as near as the k-th true neighbour."""
    kth = truth.where(F.col("rnk") == k).select("query_id", F.col("dist").alias("kth"))
    right = truth.join(kth, "query_id").where("dist <= kth").select("query_id", "neighbor_id")
    got = results.select("query_id", "neighbor_id").distinct().join(right, ["query_id", "neighbor_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("matched"))
    return kth.select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce("matched", F.lit(0)).alias("matched"), (F.least(F.coalesce("matched", F.lit(0)), F.lit(k)) / k).alias("recall"))


def recall_summary(per_query: DataFrame, outcome: Column | None = None) -> DataFrame:
    """One row: mean recall and counts of low (< 0.5) and very low (< 0.1) queries; by outcome, null if there are none."""
    out = [F.avg("recall").alias("avg_recall"), F.count_if(F.col("recall") < 0.5).alias("low"), F.count_if(F.col("recall") < 0.1).alias("very_low")]
    if outcome is not None:
        out = [F.avg("recall").alias("recall_all"), F.avg(F.when(outcome, F.col("recall"))).alias("recall_hits"), F.avg(F.when(~outcome, F.col("recall"))).alias("recall_misses")]
    return per_query.agg(*out)


def interval_metrics(log: DataFrame, size: int) -> DataFrame:
    """interval, queries, hits, hit_ratio, latency averages over each ``size`` queries of (seq, hit, ms, penalty)."""
    return log.groupBy(F.floor(F.col("seq") / size).alias("interval")).agg(
        F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("int")).alias("hit_ratio"),
        F.avg("ms").alias("avg_ms"), F.avg(F.when(F.col("hit"), F.col("ms"))).alias("avg_hit_ms"), F.avg(F.when(~F.col("hit"), F.col("penalty"))).alias("miss_penalty"), F.sum("ms").alias("sum_ms"))


def cumulative(intervals: DataFrame, block: int = 1024) -> DataFrame:
    """Running hit ratio and mean latency over intervals: sums within blocks of ``block`` intervals, after sums over the blocks before.

    One task sees a row for each block only, not for each interval of the stream.
    """
    rows = intervals.select("interval", "queries", "hits", "sum_ms", F.floor(F.col("interval") / block).alias("b"))
    sums = ("queries", "hits", "sum_ms")
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("b").agg(*[F.sum(c).alias(c) for c in sums]).select("b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])
    w = Window.partitionBy("b").orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(blocks, "b").select("interval", *[(F.sum(c).over(w) + F.col(f"{c}_before")).alias(c) for c in sums])
    return run.select("interval", F.col("queries").alias("completed"), (F.col("hits") / F.col("queries")).alias("hit_ratio"), (F.col("sum_ms") / F.col("queries")).alias("avg_ms"))


def percentiles(log: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p * n)."""
    cols = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in shares]
    return log.groupBy(*by).agg(*cols)


def percentile_floor_rank(log: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """The value at place floor(p * n) from 0, and the mean, found by counts of values rather than by a list of them."""
    counts = log.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(value)
    run = counts.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(*by))})
    return run.where((F.col("upto") > F.floor(F.col("all") * p)) & (F.col("upto") - F.col("n") <= F.floor(F.col("all") * p))).select(*by, F.col(value).alias("pct"))


def phases(log: DataFrame) -> DataFrame:
    """Per phase: queries, hits, stale hits and latency sums of all, hits and misses."""
    ms = lambda c: F.sum(F.when(c, F.col("ms")))
    return log.groupBy("phase").agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & F.col("stale")).alias("stale_hits"), ms(F.lit(True)).alias("ms_all"), ms(F.col("hit")).alias("ms_hits"), ms(~F.col("hit")).alias("ms_misses"))


def stale(results: DataFrame, deleted: DataFrame) -> DataFrame:
    """query_id, stale: whether any returned id is deleted."""
    marked = results.join(deleted.select(F.col("vec_id").alias("neighbor_id"), F.lit(True).alias("gone")), "neighbor_id", "left")
    return marked.groupBy("query_id").agg(F.max(F.coalesce("gone", F.lit(False))).alias("stale"))


def weighted(intervals: DataFrame) -> DataFrame:
    """Hit-weighted latency and miss-weighted penalty over intervals."""
    misses = F.col("queries") - F.col("hits")
    return intervals.agg((F.sum(F.col("avg_hit_ms") * F.col("hits")) / F.sum("hits")).alias("hit_ms"), (F.sum(F.col("miss_penalty") * misses) / F.sum(misses)).alias("miss_penalty"), (F.sum("hits") / F.sum("queries")).alias("hit_ratio"))


def reconstructed(hit_ratio: Column, hit_ms: Column, backend_ms: Column, penalty: Column) -> Column:
    """Latency of a stream that wasn't overloaded: hits at their own cost, misses at the backend's plus the penalty."""
    return hit_ratio * hit_ms + (1 - hit_ratio) * (backend_ms + penalty)


def split_windows(n_splits: int, window: int, stride: int, repeat: int) -> list[tuple[int, int, int]]:
    """(window, repetition, split) of sliding windows over splits, in order of play."""
    starts = range(0, max(1, n_splits - window + 1), stride)
    return [(w, r, s) for w, a in enumerate(starts) for r in range(repeat) for s in range(a, min(n_splits, a + window))]


def recall_offset(results: DataFrame, truth: DataFrame, k: int, offset: int) -> DataFrame:
    """Recall where result ids are ``offset`` above those of the truth: query_id, matched, invalid, recall.

    An id that is null or below the offset is invalid: it takes a place and matches nothing. Queries without a valid result have recall 0.
    """
    bad = F.col("neighbor_id").isNull() | (F.col("neighbor_id") < offset)
    n = results.groupBy("query_id").agg(F.count_if(bad).alias("invalid"))
    own = recall(results.where(~bad).select("query_id", (F.col("neighbor_id") - offset).alias("neighbor_id")), truth, k)
    return own.join(n, "query_id", "left").select("query_id", "matched", F.coalesce("invalid", F.lit(0)).alias("invalid"), "recall")
