"""N-gram Jaccard join: the product of the document by n-gram incidence matrix with its transpose, in blocks.

Only entries of at least the threshold count, so rows are cut to the columns that must hold a shared entry:

1. A count sketch of all n-grams (fixed size, summed over tasks) puts a document's n-grams in one global
   order, rarest first. Any order gives right results; a rare-first one gives short columns.
2. Each document keeps the head of its ordered n-grams: of two linked documents the heads share a column.
   Equal sets are one row of the matrix from here on (one *class*, named by its smallest doc_id).
3. Each column of the heads that holds several rows is a block of the product. A row's place in its order
   and the two sizes bound the overlap from above; entries whose bound is below the threshold are discarded.
   A block is first multiplied with its most central row only (as many entries as rows). What isn't linked
   to that row's component afterwards is multiplied with the rest of the block: so the links found connect
   just what all links connect, without writing all entries of a block of near copies.
4. The overlap of the remaining entries is accumulated on the heads first: what is shared there plus all that
   the longer tail could add bounds the whole overlap. Entries that may still reach the threshold are
   accumulated on the whole sets, and compared with it.

Null and empty texts have no n-grams and link with nothing. Rows with a null doc_id are ignored; rows that
share a doc_id are one document, linked by any of them. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SLICE_BITS = 16
"""The sketch travels in slices of 2**SLICE_BITS counters."""


def _grams(words: C.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, ascending, and where each text's begin. A text of fewer than n words is one n-gram."""
    grams, at = words.grams(n)
    owner = words.text_of()[at]
    short = np.flatnonzero((words.count() < n) & (words.count() > 0))
    if len(short):
        whole = [np.sum(words.hash[words.first[i] : words.first[i + 1]] * C.powers(C._P, n)[: words.count()[i]], dtype=np.uint64) for i in short]
        grams, owner = np.concatenate([grams, C.mix(np.array(whole, np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(words.first)))


def gram_counts(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """2**bits counters of how many documents hold n-grams of each hash bucket; their size doesn't depend on the input."""
    C.bound_batches(docs.sparkSession)
    width = 1 << min(SLICE_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for _, _, data, offsets in C.blocks(batch):
                grams, _ = _grams(C.Words(data, offsets), n)
                bucket, k = np.unique((grams >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                total[bucket] = np.minimum(total[bucket].astype(np.int64) + k, 65535)
        for i in range(0, len(total), width):
            if total[i : i + width].any():
                yield pa.record_batch([pa.array([i // width], pa.int32()), pa.array([pa.compress(total[i : i + width].tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(pa.decompress(counts.as_buffer(), 2 * width, codec="zstd"), np.uint16)
                sums[i] = np.minimum(sums.get(i, 0) + part.astype(np.int64), 65535).astype(np.uint16)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    slices = docs.select("text").mapInArrow(count, schema).repartition(16, "slice").mapInArrow(add, schema)
    with C.cleaned(docs.sparkSession):  # collected in one job; an iterator runs one for each partition
        rows = slices.collect()
    out = np.zeros(1 << bits, np.uint16)
    for row in rows:
        out[row.slice * width : (row.slice + 1) * width] = np.frombuffer(row.counts, np.uint16)
    return out


def heads(docs: DataFrame, n: int, percent: int, bits: int = 23) -> DataFrame:
    """Per document: doc_id, n_grams, a 128-bit fingerprint of the set (f1, f2) and the head: its rarest n-grams."""
    C.bound_batches(docs.sparkSession)
    counts = docs.sparkSession.sparkContext.broadcast(gram_counts(docs, n, bits))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in C.blocks(batch):
                grams, first = _grams(C.Words(data, offsets), n)
                size = np.diff(first)
                keep = np.where(size > 0, size - (size * percent + 99) // 100 + 1, 0)
                owner = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((grams, counts.value[(grams >> np.uint64(64 - bits)).astype(np.int64)], owner))
                place = np.arange(len(grams)) - first[:-1][owner]
                ordered = grams[order][place < keep[owner]]
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (grams, C.mix(grams ^ C._Q))]
                f1, f2 = (C.signed(s[first[1:]] - s[first[:-1]]) for s in sums)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(size), pa.array(f1), pa.array(f2), C.lists(C.signed(ordered), np.concatenate([[0], np.cumsum(keep)]))],
                    names=["doc_id", "n_grams", "f1", "f2", "head"],
                )

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(head, "doc_id long, n_grams long, f1 long, f2 long, head array<long>")


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, grams) of the whole texts of ``ids``."""

    C.bound_batches(docs.sparkSession)
    rows, keep = C.only(docs, ids)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(keep, batches):
            for a, b, data, offsets in C.blocks(batch):
                values, first = _grams(C.Words(data, offsets), n)
                yield pa.record_batch([batch.column(0).slice(a, b - a), C.lists(C.signed(values), first)], names=["doc_id", "grams"])

    return C.cut(rows.mapInArrow(grams, "doc_id long, grams array<long>"), "gram-sets")


def _likely(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs without those whose heads share too little.

    Of two heads one ends first in the global order. What its row shares with the other row lies in both heads or
    in the first row's tail, so the overlap is at most the heads' overlap plus that tail; the longer tail bounds both.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    some, keep = C.only(rows, ids, ("n_grams", "head"))
    schema = "doc_id long, n_grams long, head array<long>"
    found = some.mapInArrow(lambda batches: (keep(batch).select(["doc_id", "n_grams", "head"]) for batch in batches), schema)
    sides = pairs.join(found.toDF("b", "nb", "hb"), ["b", "nb"]).join(found.toDF("a", "na", "ha"), ["a", "na"])
    reach = F.size(F.array_intersect("ha", "hb")) + F.expr("greatest(na - size(ha), nb - size(hb))")
    return sides.where(reach * (100 + percent) >= percent * F.expr("na + nb")).select("a", "b").distinct()


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b, na, nb) those whose overlap on the whole sets reaches the threshold; ``rows``: the heads."""
    pairs = C.cut(pairs.distinct(), "gram-pairs")
    if not pairs.isEmpty():
        pairs = C.cut(_likely(rows, pairs, percent), "gram-likely")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    sets = _sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), n)
    overlap = F.size(F.array_intersect("ga", "gb"))
    sides = pairs.join(sets.toDF("b", "gb"), "b").join(sets.toDF("a", "ga"), "a")
    return C.cut(sides.where(overlap * (100 + percent) >= percent * (F.size("ga") + F.size("gb"))).select("a", "b"), "gram-links")


def _may_reach(na: str, ia: str, nb: str, ib: str, percent: int) -> str:
    """Two rows with sizes na, nb whose first shared n-gram has the places ia, ib share at most least(na-ia, nb-ib)."""
    return f"least({na} - {ia}, {nb} - {ib}) * {100 + percent} >= {percent} * ({na} + {nb})"


def join(docs: DataFrame, n: int = 5, percent: int = 80, bits: int = 23, stars: int = 1) -> DataFrame:
    """One row per document: doc_id, n_grams, class_id (smallest doc_id with the same set), component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of n consecutive words;
    component_id is the smallest doc_id that links reach. ``stars``: so many times each block is multiplied
    with a central row before what is left is multiplied out; it changes the work, never the result.
    """
    docs = docs.where("doc_id is not null")
    rows = C.cut(heads(docs, n, percent, bits), "gram-heads")
    classes = rows.where("n_grams > 0").groupBy("n_grams", "f1", "f2").agg(F.min("doc_id").alias("class_id"))
    reps = rows.where("n_grams > 0").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    entries = reps.select(F.col("doc_id").alias("d"), F.col("n_grams").cast("int").alias("n"), F.posexplode("head").alias("i", "g"))
    shared = C.cut(entries.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"), "gram-shared")  # what counting shuffled goes before the entries are shuffled
    block = C.cut(entries.join(shared, "g").select("g", "d", "n", "i"), "gram-blocks")
    centre = C.cut(block.groupBy("g").agg(F.min(F.struct("i", "d", "n")).alias("p")).select("g", "p.*").toDF("g", "pi", "pd", "pn"), "gram-centres")

    star = block.join(centre, "g").where(f"d <> pd and {_may_reach('n', 'i', 'pn', 'pi', percent)}").selectExpr("pd a", "d b", "pn na", "n nb")
    links = _verified(docs, rows, star, n, percent)
    labels = C.cut(C.components(links), "gram-labels")
    for left in range(stars, 0, -1):
        named = block.join(labels.toDF("d", "l"), "d", "left").withColumn("l", F.coalesce("l", "d"))
        named = named.join(centre.select("g", "pd").join(labels.toDF("pd", "pl"), "pd", "left").select("g", F.coalesce("pl", "pd").alias("pl")), "g")
        odd = C.cut(named.where("l <> pl"), "gram-odd")
        if odd.isEmpty():
            break
        x = odd.selectExpr("g", "d b", "n nb", "i ib", "l lb")
        if left > 1:
            x = x.groupBy("g").agg(F.min(F.struct("ib", "b", "nb", "lb")).alias("x")).select("g", "x.*")
        pairs = x.join(named.selectExpr("g", "d a", "n na", "i ia", "l la"), "g").where(f"la <> lb and {_may_reach('na', 'ia', 'nb', 'ib', percent)}")
        more = _verified(docs, rows, pairs.selectExpr("least(a, b) a", "greatest(a, b) b", "if(a < b, na, nb) na", "if(a < b, nb, na) nb"), n, percent)
        known = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = C.cut(C.components(known.union(more)), "gram-labels")

    whole = rows.select("doc_id", "n_grams", "f1", "f2").join(classes, ["n_grams", "f1", "f2"], "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return whole.join(labels.toDF("class_id", "label"), "class_id", "left").select("doc_id", "n_grams", "class_id", F.coalesce("label", "class_id").alias("component_id"))
