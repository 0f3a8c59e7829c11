"""Substring dedup by compact windows: near-duplicate passages of at least ``length`` words.

The tokens are runs of SHINGLE words. Under one hash function, all windows of a passage's length that share
their smallest token form a compact window: a node of the Cartesian tree over the token hashes, wide enough to
hold such a window. Those nodes are just the minima of sliding windows, so no tree is built. HASHES functions
give a text about 2 * HASHES / length nodes a word.

A node meets another if the same token, with the CONTEXT words on both sides of it, is the minimum of both.
Each node is paired with the first one of another document that it meets (by doc_id and place); pairs of one
document pair and offset are one candidate interval, over all hash functions. Both intervals are then read again
and compared: a window is near-duplicate if the Jaccard similarity of its tokens and those beside it reaches the
threshold. Pairing with the first keeps candidates linear in the number of nodes where a passage is shared as it
is. A node is settled once each window around it lies in a passage found.

Where a key has nodes that aren't settled, a key alone says too little: a common line has it in very many documents
that share nothing else. There the windows themselves are grouped, by more of what they hold: under each of
SALTS further hash functions, a window belongs to the smallest node in it (so a node's compact window is all those
it is the smallest of), and its signature is that node's key, the place in the window, and three of SAMPLES
tokens spread over the window. One changed word changes one of the four at most, so of a near-duplicate pair at least one of
the four choices of three agrees, unless the smallest nodes differ. Windows of one signature are paired with the first one
again. Work stays linear: no group is ever multiplied out.

Equal texts are one text up to here; each other copy is reported as a passage of the one of the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHINGLE, CONTEXT, HASHES, SHIFT, GAP = 5, 4, 4, 3, 200
SALTS, STEP, EDGE, SAMPLES = 2, 4, 3, 4
"""Signatures: hash functions, distance of a node's places in its windows, tokens left out at each end, tokens sampled."""

THIN = 50
"""Where a text says the same over and over, nodes of one key are kept about so many words apart, and the last."""


def nodes(words: C.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, place): the compact windows' minima with their context, as a hash and the place of the token's first word."""
    tokens, at = words.grams(SHINGLE)
    chosen = np.zeros(len(tokens), bool)
    for salt in C.powers(C._Q, HASHES + 1)[1:]:
        chosen |= C.minima(C.mix(tokens ^ salt), at, length - SHINGLE + 1)
    keys, begin = words.grams(SHINGLE + 2 * CONTEXT)
    spot = np.searchsorted(begin, at[chosen] - CONTEXT)
    there = spot < len(begin)
    there[there] = begin[spot[there]] == at[chosen][there] - CONTEXT
    keys, at = keys[spot[there]], at[chosen][there]
    first, run, step = C.progressions(keys, at, words.text_of()[at] if len(at) else at)
    skip = np.maximum(1, THIN // step)  # of a progression one place in so many, and the last
    many = -(-(run - 1) // skip) + 1
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    first, run, step, skip = (np.repeat(x, many) for x in (first, run, step, skip))
    places = at[first] + np.minimum(nth * skip, run - 1) * step
    order = np.argsort(places, kind="stable")
    return keys[first][order], places[order]


def _summaries(docs: DataFrame, length: int) -> DataFrame:
    C.bound_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in C.blocks(batch):
                words = C.Words(data, offsets)
                keys, at = nodes(words, length)
                bounds = np.searchsorted(at, words.first)
                places = (at - np.repeat(words.first[:-1], np.diff(bounds))).astype(np.int32)
                f1, f2 = C.fingerprints(words)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(words.count().astype(np.int32)), pa.array(f1), pa.array(f2), C.lists(C.signed(keys), bounds), C.lists(places, bounds)], names=["doc_id", "words", "f1", "f2", "keys", "places"])

    return docs.mapInArrow(run, "doc_id long, words int, f1 long, f2 long, keys array<long>, places array<int>")


def _intervals(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pair, side, from, tokens) of the wanted intervals (pair, side, doc_id, from, to): the tokens that begin in them."""
    C.bound_batches(docs.sparkSession)
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("pair", "side", "from", "to")).alias("asked"))
    asked = C.cut(asked, "intervals-asked")
    rows, keep = C.only(docs, asked.select("doc_id"))

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(keep, batches):
            yield batch.select([0, 1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in C.blocks(batch):
                words = C.Words(data, offsets)
                tokens, at = words.grams(SHINGLE)
                first = np.searchsorted(at, words.first)
                out: tuple[list, ...] = ([], [], [], [])
                for i, asks in enumerate(batch.column(2).slice(a, b - a)):
                    own = tokens[first[i] : first[i + 1]]
                    for s in asks.as_py():
                        low = max(0, s["from"])
                        for x, y in zip(out, (s["pair"], s["side"], low, C.signed(own[low : max(low, s["to"])])), strict=True):
                            x.append(y)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))], names=["pair", "side", "from", "tokens"])

    texts = rows.mapInArrow(pass_on, "doc_id long, text string")
    return texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(read, "pair long, side int, from int, tokens array<long>")


def near_windows(x: np.ndarray, y: np.ndarray, shift: int, window: int, percent: int) -> list[tuple[int, int]]:
    """Ranges [from, to) of tokens of x covered by near-duplicate windows: x[i] stands beside y[i - shift]."""
    hit = np.zeros(len(x), bool)
    for s in range(-SHIFT, SHIFT + 1):
        low, high = max(0, shift - s), min(len(x), len(y) + shift - s)
        if low < high:
            hit[low:high] |= x[low:high] == y[low - shift + s : high - shift + s]
    if len(x) < window:
        return []
    shared = np.convolve(hit, np.ones(window, np.int64), "valid") if len(x) < 4096 else np.diff(np.concatenate([[0], np.cumsum(hit)])[np.stack([np.arange(len(x) - window + 1), np.arange(window, len(x) + 1)])], axis=0)[0]
    good = np.flatnonzero(shared * (100 + percent) >= percent * 2 * window)
    if not len(good):
        return []
    breaks = np.flatnonzero(np.diff(good) > window)
    return [(int(good[i]), int(good[j]) + window) for i, j in zip([0, *(breaks + 1)], [*breaks, len(good) - 1], strict=True)]


def _compare(pairs: DataFrame, docs: DataFrame, length: int, percent: int) -> DataFrame:
    """Of candidate pairs (doc_id, other, off, low, high) the near-duplicate passages: doc_id, start, end, other, other_start."""
    pairs = C.cut(pairs.withColumn("pair", F.monotonically_increasing_id()), "intervals")
    margin, window = length, length - SHINGLE + 1
    one = pairs.select("pair", F.lit(0).alias("side"), "doc_id", (F.col("low") - margin).alias("from"), (F.col("high") + margin).alias("to"))
    two = pairs.select("pair", F.lit(1).alias("side"), F.col("other").alias("doc_id"), (F.col("low") - F.col("off") - margin).alias("from"), (F.col("high") - F.col("off") + margin).alias("to"))
    read = C.cut(_intervals(docs, one.union(two)), "interval-tokens")
    left, right = (read.where(f"side = {k}").select("pair", F.col("from").alias(f"f{k}"), F.col("tokens").alias(f"t{k}")) for k in (0, 1))
    both = pairs.join(left, "pair").join(right, "pair").select("doc_id", "other", "off", "f0", "f1", "t0", "t1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, other, off, f0, f1, t0, t1 in zip(*(batch.column(i) for i in range(7)), strict=True):
                doc, other, off, f0, f1 = (v.as_py() for v in (doc, other, off, f0, f1))
                for a, b in near_windows(t0.values.to_numpy(), t1.values.to_numpy(), off + f1 - f0, window, percent):
                    rows.append((doc, f0 + a, f0 + b + SHINGLE - 1, other, max(0, f0 + a - off), off))
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=["doc_id", "start", "end", "other", "other_start", "off"])

    return C.cut(both.mapInArrow(run, "doc_id long, start long, end long, other long, other_start long, off long"), "near-passages")


def _signatures(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, doc_id, place) with a signature as key: of the nodes ``wanted`` (key, doc_id, place) those that are the smallest of a window."""
    C.bound_batches(docs.sparkSession)
    asked = C.cut(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place")).alias("asked")), "nodes-asked")
    rows, keep = C.only(docs, asked.select("doc_id"))
    window = length - SHINGLE + 1
    samples = np.linspace(EDGE, window - 1 - EDGE, SAMPLES).astype(np.int64)

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(keep, batches):
            yield batch.select([0, 1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in C.blocks(batch):
                words = C.Words(data, offsets)
                tokens, at = words.grams(SHINGLE)
                first = np.searchsorted(at, words.first)
                lists = batch.column(2).slice(a, b - a)
                asks, owner = lists.flatten(), np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
                key, place = asks.field(0).to_numpy().view(np.uint64), asks.field(1).to_numpy().astype(np.int64)
                ids = batch.column(0).slice(a, b - a).to_numpy()
                spot = first[owner] + place + 2 * EDGE * (owner + 1)  # texts stand apart by what a window may stick out
                for salt in C.powers(C._P, SALTS + 1)[1:]:
                    rank = C.mix(key ^ salt)
                    ranks = np.full(len(tokens) + 2 * EDGE * (len(first) + 1) + 2 * window, np.uint64(2**64 - 1))
                    ranks[spot] = rank
                    least = C.sliding(ranks, window, np.minimum)
                    for o in range(0, window, STEP):
                        begin = place - o
                        ok = np.flatnonzero((begin >= -EDGE) & (begin + samples[-1] < np.diff(first)[owner]) & (least[np.maximum(0, spot - o)] == rank))
                        if not len(ok):
                            continue
                        parts = C.mix(tokens[(first[owner[ok]] + begin[ok])[:, None] + samples] ^ C.powers(C._Q, SAMPLES + 1)[1:])
                        whole = parts.sum(axis=1) + C.mix(key[ok] + np.full(1, o, np.uint64) * C._P)
                        found = C.mix(whole[:, None] - parts + np.arange(SAMPLES, dtype=np.uint64) * C._Q)  # each leaves one sample out
                        yield pa.record_batch([pa.array(C.signed(found.ravel())), pa.array(np.repeat(ids[owner[ok]], SAMPLES)), pa.array(np.repeat(place[ok], SAMPLES).astype(np.int32))], names=["key", "doc_id", "place"])

    texts = rows.mapInArrow(pass_on, "doc_id long, text string")
    return texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(read, "key long, doc_id long, place int")


def _shared(nodes_: DataFrame) -> DataFrame:
    """The nodes (key, doc_id, place) whose key two documents hold, written."""
    both = nodes_.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("key")
    return C.cut(nodes_.join(both, "key"), "compact-shared")


def _firsts(shared: DataFrame) -> DataFrame:
    """(key, p, n, q): the first node of each key, how many there are, and the first one of another document."""
    spot = F.struct("doc_id", "place")
    first = shared.groupBy("key").agg(F.min(spot).alias("p"), F.count("*").alias("n"))
    second = shared.join(first, "key").where("doc_id <> p.doc_id").groupBy("key").agg(F.min(spot).alias("q"))
    return C.cut(first.join(second, "key"), "compact-first")


def _lanes(shared: DataFrame, first: DataFrame) -> DataFrame:
    """Candidate intervals (doc_id, other, off, low, high): one for each stretch of a diagonal, cut where GAP words lack any meeting."""
    met = shared.join(first, "key").where("n > 2 or doc_id <> p.doc_id").withColumn("o", F.expr("if(doc_id = p.doc_id, q, p)"))
    met = met.select("doc_id", "place", F.col("o.doc_id").alias("other"), (F.col("place") - F.col("o.place")).alias("off"))
    lane = met.groupBy("doc_id", "other", "off", F.floor(F.col("place") / GAP).alias("g")).agg(F.min("place").alias("low"), F.max("place").alias("high"))
    return lane.select("doc_id", "other", "off", "low", "high")


def _both(found: DataFrame) -> DataFrame:
    """Passages of ``_compare`` from the view of both documents: doc_id, start, end, other_doc_id, other_start."""
    near = found.select("doc_id", "start", "end", F.col("other").alias("other_doc_id"), "other_start")
    back = found.select(F.col("other").alias("doc_id"), F.col("other_start").alias("start"), (F.col("other_start") + F.col("end") - F.col("start")).alias("end"), F.col("doc_id").alias("other_doc_id"), F.col("start").alias("other_start"))
    return near.unionByName(back.groupBy("doc_id", "start", "end").agg(F.min("other_doc_id").alias("other_doc_id"), F.min_by("other_start", "other_doc_id").alias("other_start")))


def _merged(found: DataFrame) -> DataFrame:
    """Passages of one document that overlap or adjoin as one: doc_id, start, end, o (the smallest other_doc_id and other_start)."""
    reach = F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    marked = marked.withColumn("run", F.sum("new").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("other_doc_id", "other_start")).alias("o"))


def passages(docs: DataFrame, length: int = 50, percent: int = 80) -> DataFrame:
    """Passages near-duplicate across documents: doc_id, start, end (word range), n_words, other_doc_id, other_start.

    Each row's passage is made of windows of ``length`` words whose 5-word runs have a Jaccard similarity of at
    least percent / 100 with those of other_doc_id at other_start, aligned within SHIFT words; other_doc_id is
    the smallest document that any part of the passage was paired with. Passages of one document that overlap or
    adjoin are one row; both documents of a pair have rows. Null, empty and shorter
    texts have none, nor has what repeats within one document only. Rows with a null doc_id are ignored; rows
    that share a doc_id are one document. Extra columns aren't read.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    rows = C.cut(_summaries(docs, length), "compact-windows").where(f"words >= {length}")
    classes = rows.groupBy("words", "f1", "f2").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"))
    copied = rows.select("doc_id", "words", "f1", "f2").join(classes.where("keep <> last"), ["words", "f1", "f2"])
    zero = F.lit(0).cast("long")
    whole = copied.select("doc_id", zero.alias("start"), F.col("words").cast("long").alias("end"), F.when(F.expr("doc_id = keep"), F.col("last")).otherwise(F.col("keep")).alias("other_doc_id"), zero.alias("other_start")).distinct()

    reps = rows.join(classes.select(F.col("keep").alias("doc_id")), "doc_id", "left_semi")
    every = reps.select("doc_id", F.explode(F.arrays_zip("keys", "places")).alias("s")).select(F.col("s.keys").alias("key"), "doc_id", F.col("s.places").alias("place"))
    left = _shared(every)
    first = _firsts(left)
    lanes = C.cut(_lanes(left, first), "compact-lanes")
    out = whole.unionByName(_both(_compare(lanes, docs, length, percent)))
    out = C.cut(_merged(out).select("doc_id", "start", "end", "o.other_doc_id", "o.other_start"), "compact-found")

    # the first node of a key has met all others, a settled one can find no more; where others are left, windows are grouped
    open_ = left.join(first.where("n > 2").select("key", "p"), "key").where("doc_id <> p.doc_id or place <> p.place").select("key", "doc_id", "place")
    span = open_.join(rows.select("doc_id", "words").distinct(), "doc_id").select("key", "doc_id", "place", F.greatest(F.lit(0), F.col("place") - (length - SHINGLE)).alias("low"), F.least("words", F.col("place") + length).alias("high"))
    ranges = out.select(F.col("doc_id").alias("d"), "start", "end")
    open_ = span.join(ranges, F.expr("doc_id = d and start <= low and end >= high"), "left_anti").select("key").distinct()
    wanted = left.join(open_, "key", "left_semi")
    windows = _shared(_signatures(docs, wanted, length))
    again = _lanes(windows, _firsts(windows)).join(lanes, ["doc_id", "other", "off", "low", "high"], "left_anti")
    out = out.unionByName(_both(_compare(again, docs, length, percent)))
    return _merged(out).select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "o.other_doc_id", "o.other_start")
