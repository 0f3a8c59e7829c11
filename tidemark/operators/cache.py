"""The query-aware cache: thresholds by region, hit tests, and the fold that replays a query stream.

``Cache.step`` is the one state machine; batch replay, streaming and tests all use it. A step is: find the
cached vectors nearest to the query; decide hit or miss by the threshold of the query's region and k; on a miss
take the backend's answer, admit its vectors, then move the threshold. Admission and threshold come before the
next query. The backend's answers are computed in bulk beforehand, so the fold does no search of its own but
among cached vectors.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


@dataclass(frozen=True)
class CacheConfig:
    """p: weight of the newest distance; deviation: slack of the hit test; alpha, radius: how a write tightens regions nearby."""

    k: int = 10
    p: float = 0.9
    deviation: float = 0.0
    dims: int = 4
    buckets: int = 8
    low: float = -0.5
    high: float = 0.5
    shards: int = 4
    capacity: int = 400
    max_regions: int = 1_000_000
    alpha: float = 0.8
    radius: int = 1
    by_region: bool = True
    strict_reference_k: bool = False


@dataclass
class Cache:
    """State of one cache: vectors by shard in order of last use, thresholds by (region, k) in order of first use, tombstones."""

    config: CacheConfig
    shards: OrderedDict[int, dict[int, np.ndarray]] = field(default_factory=OrderedDict)
    regions: OrderedDict[tuple, dict[int, float]] = field(default_factory=OrderedDict)
    discounts: dict[tuple, float] = field(default_factory=dict)
    dead: set[int] = field(default_factory=set)
    active: int = 0
    tightened: int = 0

    def __post_init__(self) -> None:
        for s in range(self.config.shards):
            self.shards.setdefault(s, {})

    def region(self, q: np.ndarray) -> tuple:
        c = self.config
        if not c.by_region:
            return ()
        return tuple(np.minimum(c.buckets - 1, np.floor(np.clip((q[: c.dims] - c.low) / (c.high - c.low), 0, 1) * c.buckets)).astype(int).tolist())

    def _thetas(self, region: tuple) -> dict[int, float]:
        """A region that is met for the first time is created; the oldest goes if there are too many."""
        if region not in self.regions:
            if len(self.regions) >= self.config.max_regions:
                old, _ = self.regions.popitem(last=False)
                self.discounts.pop(old, None)
            self.regions[region] = {}
        return self.regions[region]

    def lookup(self, q: np.ndarray, k: int) -> list[tuple[float, int, int]]:
        """(distance, id, shard) of the k nearest live cached vectors."""
        best: dict[int, tuple[float, int]] = {}
        for s, vectors in self.shards.items():
            if vectors:
                ids = list(vectors)
                for i, d in zip(ids, ((np.stack([vectors[i] for i in ids]) - q) ** 2).sum(1).tolist(), strict=True):
                    if i not in self.dead and (i not in best or d < best[i][0]):
                        best[i] = (d, s)
        return sorted((d, i, s) for i, (d, s) in best.items())[:k]

    def step(self, q: np.ndarray, k: int, answer: list[tuple[int, float, np.ndarray]]) -> tuple[bool, list[tuple[int, float]], float | None]:
        """(hit, [(id, distance)], threshold that was tested). ``answer``: the backend's k nearest with their vectors."""
        c, found = self.config, self.lookup(q, k)
        region = self.region(q)
        thetas = self._thetas(region)
        theta = thetas.get(k, 0.0 if c.strict_reference_k and k not in (1, 5, 10, 100) else None)
        if len(found) == k and theta is not None and found[-1][0] <= (1 + c.deviation) * theta:
            counts = {s: sum(1 for x in found if x[2] == s) for s in {x[2] for x in found}}
            for s in sorted(counts, key=lambda s: (counts[s], s)):  # the shard that gave most is used last
                self.shards.move_to_end(s)
            return True, [(i, d) for d, i, _ in found], theta
        live = [(i, d, v) for i, d, v in answer if i not in self.dead][:k]
        for i, _, v in live:
            self._admit(i, v)
        if len(live) == k:
            thetas[k] = live[-1][1] if thetas.get(k) is None else c.p * live[-1][1] + (1 - c.p) * thetas[k]
            self.discounts[region] = 1.0
        return False, [(i, d) for i, d, _ in live], theta

    def _admit(self, i: int, v: np.ndarray) -> None:
        if any(i in vectors for vectors in self.shards.values()):
            return
        room = -(-self.config.capacity // self.config.shards)
        if len(self.shards[self.active]) >= room:
            for s, vectors in self.shards.items():  # reclaim tombstones first
                for x in [x for x in vectors if x in self.dead]:
                    del vectors[x]
                    self.active = s
            open_shards = [s for s, vectors in self.shards.items() if len(vectors) < room]
            if open_shards:
                self.active = min(open_shards, key=lambda s: (len(self.shards[s]), s))
            else:  # the least recently used shard is dropped and becomes the one to fill
                self.active = next(iter(self.shards))
                self.shards[self.active] = {}
            self.shards.move_to_end(self.active)
        self.shards[self.active][i] = v

    def write(self, v: np.ndarray, i: int | None = None, delete: bool = False) -> None:
        """An insert or delete of v: regions nearby get tighter, unless they are already; a delete leaves a tombstone."""
        c, at = self.config, self.region(v)
        if 0 < c.alpha < 1:
            for region, thetas in self.regions.items():
                if thetas and sum(abs(a - b) for a, b in zip(region, at, strict=True)) <= c.radius and self.discounts.get(region, 1.0) > c.alpha:
                    for k in thetas:
                        thetas[k] *= c.alpha
                    self.discounts[region] = c.alpha
                    self.tightened += 1
        if i is not None:
            (self.dead.add if delete else self.dead.discard)(i)


RESULT = "cache_id long, query_seq long, hit boolean, kth double, theta double, ids array<long>, dists array<double>"


def replay_rows(cache: Cache, rows: pd.DataFrame) -> Iterator[tuple]:
    """Results of the queries (query_seq, k, embedding, ids, dists, vectors), taken in order of query_seq."""
    for r in rows.sort_values("query_seq").itertuples():
        answer = [(int(i), float(d), np.asarray(v, float)) for i, d, v in zip(r.ids, r.dists, r.vectors, strict=True)]
        hit, found, theta = cache.step(np.asarray(r.embedding, float), int(r.k), answer)
        yield int(r.query_seq), hit, found[-1][1] if found else None, theta, [i for i, _ in found], [d for _, d in found]


def replay(stream: DataFrame, config: CacheConfig) -> DataFrame:
    """Replay of independent caches: stream (cache_id, query_seq, k, embedding, ids, dists, vectors) to RESULT, a fold per cache.

    Hits move thresholds and thresholds move hits, so one cache's queries follow each other in one task; caches run
    in parallel. Rows are sorted by Spark, which spills, and folded batch by batch: a task holds one cache's state
    and one batch, however long the stream is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, own = None, None
        for batch in batches:
            out = []
            for cache_id, rows in batch.groupby("cache_id", sort=False):
                if own != cache_id:
                    cache, own = Cache(config), cache_id
                out += [(int(cache_id), *r) for r in replay_rows(cache, rows)]
            yield pd.DataFrame(out, columns=["cache_id", "query_seq", "hit", "kth", "theta", "ids", "dists"])

    return stream.repartition("cache_id").sortWithinPartitions("cache_id", "query_seq").mapInPandas(run, RESULT)


def with_answers(stream: DataFrame, answers: DataFrame, base: DataFrame) -> DataFrame:
    """``stream`` (.., query_id, embedding) joined with the bulk answers (query_id, rnk, neighbor_id, dist) and their vectors."""
    full = answers.join(base.select(F.col("vec_id").alias("neighbor_id"), F.col("embedding").alias("v")), "neighbor_id")
    lists = full.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "neighbor_id", "dist", "v"))).alias("a"))
    part = lambda n: F.transform("a", lambda s: s[n])
    return stream.join(lists, "query_id").select(*stream.columns, part("neighbor_id").alias("ids"), part("dist").alias("dists"), part("v").alias("vectors"))


# --- the relational parts ----------------------------------------------------------------------


def ema(values: Column, p: float) -> Column:
    """Threshold after distances in order: the first replaces, later ones weigh p."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda t, d: F.when(t.isNull(), d).otherwise(p * d + (1 - p) * t))


def theta_table(seen: DataFrame, p: float) -> DataFrame:
    """region, theta of (region, seq, d): misses' k-th distances folded in order of seq."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "d"))), lambda s: s["d"])
    return seen.groupBy("region").agg(ordered.alias("ds")).select("region", ema(F.col("ds"), p).alias("theta"))


def hit_test(queries: DataFrame, thetas: DataFrame, deviation: float, by_region: bool = True) -> DataFrame:
    """``queries`` (query_id, region, d_k, n) with ``hit``: enough results, a known threshold, and d_k within it."""
    if by_region:
        joined = queries.join(thetas, "region", "left")
    else:
        joined = queries.join(F.broadcast(thetas.agg(F.max("theta").alias("theta"))))  # one row
    return joined.withColumn("hit", F.coalesce(F.col("n") & (F.col("d_k") <= (1 + deviation) * F.col("theta")), F.lit(False)))


def tighten(thetas: DataFrame, writes: DataFrame, alpha: float, radius: int) -> DataFrame:
    """``thetas`` (region, theta) after writes (region) nearby: multiplied by alpha once, however many there were.

    Only keys next to a written one are generated and joined by equality, so no region meets all others.
    """
    if not 0 < alpha < 1:
        return thetas.withColumn("tightened", F.lit(False))
    near = writes.select("region").distinct()
    for _ in range(radius):
        step = lambda i, by: F.transform("region", lambda x, j: F.when(j == i - 1, x + by).otherwise(x))
        moves = F.flatten(F.transform(F.sequence(F.lit(1), F.size("region")), lambda i: F.array(step(i, -1), step(i, 1))))
        near = near.select(F.explode(F.array_append(moves, F.col("region"))).alias("region")).distinct()
    return thetas.join(near.withColumn("near", F.lit(True)), "region", "left").select("region", F.when(F.col("near"), F.col("theta") * alpha).otherwise(F.col("theta")).alias("theta"), F.coalesce("near", F.lit(False)).alias("tightened"))


def newest(rows: DataFrame, key: str, seq: str, n: int, first: bool = False) -> DataFrame:
    """The n keys used last (or first seen last), by rank: what an LRU (or FIFO) of n keys holds."""
    when = rows.groupBy(key).agg((F.min if first else F.max)(seq).alias("seq"))
    return when.orderBy(F.desc("seq"), key).limit(n)


def lru_order(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Keys with their place in order of last use, newest first; the last is the victim. Keys are shards, so few."""
    when = rows.groupBy(key).agg(F.max(seq).alias("last_seq"))
    return when.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_seq"), key)).cast("long"))


def region_of(embedding: Column, config: CacheConfig) -> Column:
    return V.region_key(embedding, config.dims, config.buckets, config.low, config.high)
