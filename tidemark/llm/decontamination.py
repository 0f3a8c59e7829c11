"""Benchmark decontamination by spaced seeds: hits of masked word windows, then substitution-tolerant checks.

A window is ``WINDOW`` consecutive words. Its positions fall into four groups (i mod 4); each mask keeps two of
the groups and ignores the others, so two windows that differ in at most two words agree under one of the six
masks at least: whatever two words were substituted, no overlap is missed. A hit is then compared word for
word, and extended to both sides while the substitutions stay as rare.

The benchmark is a stated query set. It is taken in blocks of at most ``BLOCK_WORDS`` words, whose hashes (a few
MB) are sent to the tasks; each block is one scan of the documents, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW, SUBSTITUTIONS, SHORTEST = 13, 2, 5
BLOCK_WORDS = 200_000
MASKS = list(combinations(range(SUBSTITUTIONS + 2), 2))
FILTER_BITS = 20

SCHEMA = "doc_id long, item_id long, matched long, item_words long, first_word long, end_word long"


def _seeds(words: C.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mask number, hashes, positions) of all windows under each mask."""
    at = np.flatnonzero(np.arange(len(words)) + WINDOW <= np.repeat(words.first[1:], words.count()))
    coefficient = C.powers(C._P, WINDOW + 1)[1:]
    groups = []
    for g in range(SUBSTITUTIONS + 2):
        total = np.zeros(len(at), np.uint64)
        for i in range(g, WINDOW, SUBSTITUTIONS + 2):
            total += words.hash[at + i] * coefficient[i]
        groups.append(total)
    for number, kept in enumerate(MASKS):
        yield number, C.mix(sum(groups[g] for g in kept) + np.uint64(number)), at


class _Items:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, ids: list[int], texts: list[str]):
        data = [(t or "").encode() for t in texts]
        words = C.Words(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
        self.ids, self.hash, self.first = np.array(ids, np.int64), words.hash, words.first
        owner = words.text_of()
        hashes, at = [], []
        for _, h, p in _seeds(words):
            hashes.append(h)
            at.append(p)
        self.hashes, self.at = self._sorted(np.concatenate(hashes), np.concatenate(at))
        self.short = {}  # items of fewer words than a window: exact matches of all words
        for n in range(SHORTEST, WINDOW):
            if len(items := np.flatnonzero(words.count() == n)):
                grams, p = words.grams(n)
                whole = np.isin(p, words.first[items])
                self.short[n] = self._sorted(grams[whole], p[whole])
        self.owner = owner

    @staticmethod
    def _sorted(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(hashes, kind="stable")
        return hashes[order], at[order]


def _join(sought: np.ndarray, hashes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into sought, into the sorted hashes) of equal hashes. seen: filter by their top bits."""
    maybe = np.flatnonzero(seen[(sought >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    low = np.searchsorted(hashes, sought[maybe], "left")
    k = np.searchsorted(hashes, sought[maybe], "right") - low
    left = np.repeat(maybe, k)
    return left, np.repeat(low, k) + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)


def _filter(hashes: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return seen


def _matches(words: C.Words, items: _Items, seen: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, item, matched words, first word, end word) of verified overlaps, several for a text and item at times."""
    owner = words.text_of()
    lines = []  # (place in the documents, place in the items) of hits
    for _, hashes, at in _seeds(words):
        left, right = _join(hashes, items.hashes, seen[0])
        lines.append(np.stack([at[left], items.at[right]]))
    a, b = np.unique(np.concatenate(lines, axis=1), axis=1)
    if len(a):
        same = words.hash[a[:, None] + np.arange(WINDOW)] == items.hash[b[:, None] + np.arange(WINDOW)]
        good = same.sum(axis=1) >= WINDOW - SUBSTITUTIONS
        a, b = a[good], b[good]
    if len(a):
        # one alignment: the same text, item and offset
        key = np.stack([owner[a], items.owner[b], a - b])
        kinds, index = np.unique(key, axis=1, return_inverse=True)
        for k in range(kinds.shape[1]):
            text, item, shift = kinds[:, k]
            lo = max(words.first[text], items.first[item] + shift)
            hi = min(words.first[text + 1], items.first[item + 1] + shift)
            equal = words.hash[lo:hi] == items.hash[lo - shift : hi - shift]
            own = a[index.ravel() == k]
            s, e = int(own.min() - lo), int(own.max() + WINDOW - lo)
            while s > 0 and (equal[s - 1] or equal[max(0, s - WINDOW) : s].mean() >= 1 - SUBSTITUTIONS / WINDOW):
                s -= 1
            while e < len(equal) and (equal[e] or equal[e : e + WINDOW].mean() >= 1 - SUBSTITUTIONS / WINDOW):
                e += 1
            yield text, item, int(equal[s:e].sum()), int(lo + s - words.first[text]), int(lo + e - words.first[text])
    for n, (hashes, places) in items.short.items():
        grams, at = words.grams(n)
        left, right = _join(grams, hashes, seen[n])
        for p, q in zip(at[left], places[right], strict=True):
            if (words.hash[p : p + n] == items.hash[q : q + n]).all():
                yield owner[p], items.owner[q], n, int(p - words.first[owner[p]]), int(p + n - words.first[owner[p]])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that overlap: the longest overlap found.

    doc_id, item_id, matched (equal words), item_words, first_word and end_word (its range in the document).
    An overlap has a window of WINDOW words with at most SUBSTITUTIONS of them substituted; items of SHORTEST to
    WINDOW - 1 words must occur whole; shorter, empty and null items match nothing, as do null and empty texts.
    Words are compared with A-Z lower-cased. Rows without doc_id or item_id are ignored, rows that repeat count once.
    """
    C.bound_batches(docs.sparkSession)
    spark = docs.sparkSession

    def scan(block: object):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _Items(*block.value)
            seen = {0: _filter(items.hashes)} | {n: _filter(h) for n, (h, _) in items.short.items()}
            for batch in batches:
                for first, after, data, offsets in C.blocks(batch):
                    words, ids = C.Words(data, offsets), batch.column(0).slice(first, after - first).to_numpy()
                    if rows := [(ids[t], items.ids[i], m, items.first[i + 1] - items.first[i], s, e) for t, i, m, s, e in _matches(words, items, seen)]:
                        yield pa.record_batch([pa.array(np.array(x, np.int64)) for x in zip(*rows, strict=True)], names=["doc_id", "item_id", "matched", "item_words", "first_word", "end_word"])

        return run

    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    parts, ids, texts, size = [], [], [], 0

    def flush() -> None:
        nonlocal ids, texts, size
        if ids:
            parts.append(source.mapInArrow(scan(spark.sparkContext.broadcast((ids, texts))), SCHEMA))
        ids, texts, size = [], [], 0

    for row in benchmark.where("item_id is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text or "")
        size += len(texts[-1]) // 2 + 1
        if size >= BLOCK_WORDS:
            flush()
    flush()
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("matched"), "first_word", "end_word")
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item; columns and rows else as they are.

    Rows that share a doc_id go together. A row without a doc_id is never found to overlap, so it stays; null and
    empty texts overlap nothing.
    """
    return C.without(docs, overlaps(docs, benchmark).select("doc_id").distinct())
