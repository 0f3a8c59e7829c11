"""Importance resampling: how much likelier target text is than raw text under hashed n-gram models, and a sample by it.

Words and pairs of words are hashed to BUCKETS buckets. One bag-of-n-grams model is counted over all documents
(raw), one over a bounded sample of target documents; a document's log weight is the sum over its n-grams of
the log ratio of the two smoothed models. Adding a Gumbel variate to each log weight and keeping the k largest
keys draws k documents without replacement, in proportion to their weights. The variate comes from a hash of
doc_id, so a rerun or a lost executor draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
TARGET_SAMPLE = 20_000
"""At most so many target documents are counted, those with the smallest hashes of doc_id."""
BINS = 4096


def _buckets(words: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all words and word pairs."""
    pairs, at = words.grams(2)
    owner = words.text_of()
    return (np.concatenate([C.mix(words.hash), pairs]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate([owner, owner[at]])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all of ``docs``; summed in slices over tasks."""
    C.bound_batches(docs.sparkSession)
    width = BUCKETS // 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in C.blocks(batch):
                total += np.bincount(_buckets(C.Words(data, offsets))[0], minlength=BUCKETS)
        yield pa.record_batch([pa.array(range(16), pa.int32()), pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(16)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    schema, out = "slice int, counts binary", np.zeros(BUCKETS, np.int64)
    for row in docs.select("text").mapInArrow(count, schema).repartition(16, "slice").mapInArrow(add, schema).toLocalIterator():
        out[row.slice * width : (row.slice + 1) * width] += np.frombuffer(row.counts, np.int64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket log p_target - log p_raw, each smoothed by one count for each bucket."""
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def gumbel(ident: Column, seed: int) -> Column:
    """A standard Gumbel variate from a hash of ``ident``."""
    u = (F.shiftrightunsigned(F.xxhash64(ident, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def weights(docs: DataFrame, target_ids: DataFrame, seed: int = 0) -> DataFrame:
    """Per document: doc_id, n_grams, log_weight, key (log weight plus Gumbel variate). ``target_ids``: doc_id of target text."""
    C.bound_batches(docs.sparkSession)
    sample = F.broadcast(target_ids.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_SAMPLE))
    ratio = log_ratio(bucket_counts(docs.join(sample, "doc_id", "left_semi")), bucket_counts(docs))
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in C.blocks(batch):
                bucket, owner = _buckets(C.Words(data, offsets))
                n = np.bincount(owner, minlength=b - a)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(np.bincount(owner, sent.value[bucket], minlength=b - a))], names=["doc_id", "n_grams", "log_weight"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")
    return rows.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))


def top_keys(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows with the largest key, ties by doc_id, found by counts per key range: no global sort, no single task.

    Each pass counts the rows in BINS ranges and narrows on the one that holds the k-th, until that one is small.
    """
    if k <= 0:
        return rows.limit(0)
    low, high, n = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if n <= k:
        return rows
    above, inside = 0, n
    while inside > 1000 and high > low:
        bin_of = F.least(F.lit(BINS - 1), F.floor((F.col("key") - low) / ((high - low) / BINS)))
        counts = dict(rows.where(F.col("key").between(low, high)).groupBy(bin_of.alias("b")).agg(F.struct(F.count("*"), F.min("key"), F.max("key"))).collect())
        for b in sorted(counts, reverse=True):
            if above + counts[b][0] >= k:
                inside, low, high = counts[b]
                break
            above += counts[b][0]
    sure = rows.where(F.col("key") > high)
    edge = rows.where(F.col("key").between(low, high)).orderBy(F.desc("key"), "doc_id").limit(k - above)
    return sure.unionByName(edge)


def resample(docs: DataFrame, target_ids: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A sample of ``k`` documents: doc_id, n_grams, log_weight, key.

    Null and empty texts have no n-grams and log weight 0. Rows with a null doc_id are ignored; rows that share a
    doc_id share the variate. Without target documents all weights follow the raw model alone. If k is the number
    of rows or more, all are returned. Only doc_id and text are read.
    """
    return top_keys(C.cut(weights(docs, target_ids, seed), "weights"), k)
