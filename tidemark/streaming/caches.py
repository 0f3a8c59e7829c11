"""Streaming forms of the caches: the same fold as batch replay, with its state kept between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cache import RESULT, Cache, CacheConfig, replay_rows


def cached_search(stream: DataFrame, config: CacheConfig) -> DataFrame:
    """Results of a stream of queries with their backend answers, as ``cache.replay`` gives them.

    Rows of one micro-batch are taken in order of query_seq; the cache of each cache_id is its state.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = pickle.loads(state.get[0]) if state.exists else Cache(config)
        rows = pd.concat(list(batches))
        out = [(int(key[0]), *r) for r in replay_rows(cache, rows)]
        state.update((pickle.dumps(cache),))
        yield pd.DataFrame(out, columns=["cache_id", "query_seq", "hit", "kth", "theta", "ids", "dists"])

    return stream.groupBy("cache_id").applyInPandasWithState(run, RESULT, "cache binary", "append", GroupStateTimeout.NoTimeout)


def thetas(stream: DataFrame, p: float) -> DataFrame:
    """region, theta after each micro-batch of (region, seq, d): the moving threshold of each region."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        theta = state.get[0] if state.exists else None
        for d in pd.concat(list(batches)).sort_values("seq")["d"]:
            theta = d if theta is None else p * d + (1 - p) * theta
        state.update((theta,))
        yield pd.DataFrame({"region": [key[0]], "theta": [theta]})

    return stream.groupBy("region").applyInPandasWithState(run, "region long, theta double", "theta double", "update", GroupStateTimeout.NoTimeout)


def interval_counts(events: DataFrame, size: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts and mean value by event time windows of ``events`` (ts, event_type, value), late rows dropped after the watermark."""
    from pyspark.sql import functions as F

    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", lateness).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Sessions of each user in ``events`` (ts, user_id, value): start, end, n, total; a session ends when nothing comes for ``gap``."""
    from pyspark.sql import functions as F

    window = F.session_window("ts", gap)
    found = events.withWatermark("ts", lateness).groupBy(window.alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def apply_mutations(inserts: str, deletes: str):
    """A foreachBatch function for (op, vec_id, seq, embedding): inserts go to one table, deletes to the tombstones, each with its batch number.

    ``graph.compact`` folds both into the live rows by seq, so a batch that is written again after a failure changes nothing.
    """
    from pyspark.sql import functions as F

    def write(batch: DataFrame, number: int) -> None:
        for op, path, columns in (("insert", inserts, ["vec_id", "seq", "embedding"]), ("delete", deletes, ["vec_id", "seq"])):
            batch.where(F.col("op") == op).select(*columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def visible(writes: DataFrame, at: int, delay: int) -> DataFrame:
    """Of ``writes`` (seq, ..) those that a query at ``at`` sees when they are applied ``delay`` steps after they came."""
    return writes.where(f"seq + {int(delay)} <= {int(at)}")


def apply_deletes(path: str):
    """A foreachBatch function that appends deleted ids (vec_id, seq) to the tombstone table at ``path``."""

    def write(batch: DataFrame, _: int) -> None:
        batch.select("vec_id", "seq").write.mode("append").parquet(path)

    return write
