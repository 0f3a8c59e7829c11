"""Sparse suffix arrays: passages of at least ``length`` words that occur more than once.

1. Of every text only the suffixes at minimiser positions are kept: among WINDOW successive starts, where the
   hash of the next HEAD words is smallest. Two occurrences of a passage of HEAD + WINDOW - 1 = length words
   choose the same positions inside it, so each has a kept suffix there. Suffixes whose head stands alone drop out.
2. The kept suffixes are sorted by what follows them (range partitions of head and text, as one byte a word) and
   each is compared with its neighbours: the longer common start is how far any match of it reaches to the right.
   Then they are sorted by head and what precedes them, and the same gives how far any match extends to the left.
   A neighbour beyond a partition's edge counts as equal. Only where both reaches add up to ``length`` words or more
   can the suffix lie in a repeated passage.
3. A suffix's farthest match to the left and that to the right may be different ones, and of each repeat the first
   occurrence is wanted: so the windows of ``length`` words within the reaches are counted by fingerprint. Adjoining
   repeated windows make one passage.

Whole texts that are equal are one text up to here: all but the one of the smallest doc_id repeat it.
Sorting splits equal suffixes by place, and of windows only minima and maxima per fingerprint are taken, windows
of a text that are equal at equal steps as one row; so a passage in very many documents is no large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HEAD = 16


def minimisers(words: C.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(head hashes, positions) of the kept suffixes of all texts of at least ``length`` words."""
    heads, at = words.grams(HEAD)
    kept = C.minima(heads, at, length - HEAD + 1)
    return heads[kept], at[kept]


def _summaries(docs: DataFrame, length: int) -> DataFrame:
    """Per document: doc_id, words, fingerprint of all words (f1, f2), heads of the kept suffixes, each once, and whether the text has it twice."""

    C.bound_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in C.blocks(batch):
                words = C.Words(data, offsets)
                heads, at = minimisers(words, length)
                owner = words.text_of()[at]
                order = np.lexsort((heads, owner))
                heads, owner = heads[order], owner[order]
                new = np.ones(len(heads), bool)
                new[1:] = (heads[1:] != heads[:-1]) | (owner[1:] != owner[:-1])
                begin = np.flatnonzero(new)
                twice = np.diff(np.append(begin, len(heads))) > 1
                bounds = np.searchsorted(owner[new], np.arange(len(words.first)))
                size = words.count()
                prints = [pa.array(x) for x in C.fingerprints(words)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(size.astype(np.int32)), *prints, C.lists(C.signed(heads[new]), bounds), C.lists(twice, bounds)], names=["doc_id", "words", "f1", "f2", "heads", "twice"])

    return C.cut_mapped(docs, run, "doc_id long, words int, f1 long, f2 long, heads array<long>, twice array<boolean>", "suffixes")


def _read(docs: DataFrame, asked: DataFrame, column: str, each, schema: str, name: str) -> DataFrame:
    """``each(words, list column, ids)`` of the blocks of documents in ``asked`` (doc_id, ``column``), as a cut."""
    C.bound_batches(docs.sparkSession)
    rows, keep = C.only(docs, asked.select("doc_id"))

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(keep, batches):
            yield batch.select([0, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in C.blocks(batch):
                yield each(C.Words(data, offsets), batch.column(2).slice(a, b - a), batch.column(0).slice(a, b - a).to_numpy())

    texts = rows.mapInArrow(pass_on, "doc_id long, text string")
    return C.cut_mapped(texts.join(asked, "doc_id").select("doc_id", "text", column), run, schema, name)


def _suffixes(docs: DataFrame, suspects: DataFrame, length: int) -> DataFrame:
    """(head, doc_id, place, after, before) of the kept suffixes whose head is among the document's ``matched``; a byte a word, that next to the head first."""
    reach = length - HEAD

    def each(words: C.Words, matched: pa.Array, ids: np.ndarray) -> pa.RecordBatch:
        heads, at = minimisers(words, length)
        bounds = np.searchsorted(at, words.first)
        known = [np.isin(C.signed(heads[bounds[i] : bounds[i + 1]]), m.values.to_numpy()) for i, m in enumerate(matched)]
        chosen = np.concatenate(known) if known else np.zeros(0, bool)
        heads, at = heads[chosen], at[chosen]
        owner = words.text_of()[at]
        low, high = words.first[owner], words.first[owner + 1]
        letters = np.append((words.hash >> np.uint64(56)).astype(np.uint8), np.uint8(0))
        out = []
        for places, there in ((at[:, None] + HEAD + np.arange(reach), lambda p: p < high[:, None]), (at[:, None] - 1 - np.arange(reach), lambda p: p >= low[:, None])):
            side = np.where(there(places), letters[np.clip(places, 0, len(words))], np.uint8(0))
            out.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(reach), len(at), [None, pa.py_buffer(np.ascontiguousarray(side))]).cast(pa.binary()))
        return pa.record_batch([pa.array(C.signed(heads)), pa.array(ids[owner]), pa.array((at - low).astype(np.int32)), *out], names=["head", "doc_id", "place", "after", "before"])

    return _read(docs, suspects, "matched", each, "head long, doc_id long, place int, after binary, before binary", "suffixes-kept")


def _reach(sorted_rows: DataFrame, side: str, width: int, name: str, keep: list[str]) -> tuple:
    """A step and its schema for rows sorted by (head, ``side``): ``keep`` columns and ``name``, the longer common start of ``side`` with either neighbour of the same head; rows that have none go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows wait until the row after them is seen; before the first and after the last row an equal one is assumed
        waiting, above = None, width
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if waiting is not None:
                table = pa.concat_tables([waiting, table]).combine_chunks()
            yield from done(table, above, None)
            above = common(table.slice(table.num_rows - 2)) if table.num_rows > 1 else [above]
            above, waiting = int(above[0]), table.slice(table.num_rows - 1)
        if waiting is not None:
            yield from done(waiting, above, width)

    def common(table: pa.Table) -> np.ndarray:
        """Of each pair of neighbouring rows the length of the common start, -1 for different heads."""
        head = table["head"].to_numpy()
        text = np.frombuffer(b"".join(table[side].to_pylist()), np.uint8).reshape(-1, width)
        differ = np.hstack([text[1:] != text[:-1], np.ones((len(text) - 1, 1), bool)])
        return np.where(head[1:] == head[:-1], differ.argmax(axis=1), -1)

    def done(table: pa.Table, above: int, below: int | None) -> Iterator[pa.RecordBatch]:
        between = common(table)
        up = np.concatenate([[above], between])
        best = np.maximum(up, np.append(between, below)) if below is not None else np.maximum(up[:-1], between)
        if len(best):
            some = table.slice(0, len(best)).select(keep).append_column(name, pa.array(best.astype(np.int32))).filter(pa.array(best >= 0))
            yield from some.combine_chunks().to_batches()

    kinds = dict(sorted_rows.dtypes)
    return run, ", ".join(f"{c} {kinds[c]}" for c in keep) + f", {name} int"


def _candidates(suffixes: DataFrame, length: int) -> DataFrame:
    """(doc_id, reaches): of each suffix that may lie in a repeated passage its place, and how many words before and after it repeat."""
    width = length - HEAD
    right = suffixes.repartitionByRange("head", "after", "doc_id", "place").sortWithinPartitions("head", "after", "doc_id", "place")
    right = C.cut_mapped(right, *_reach(right, "after", width, "ahead", ["head", "doc_id", "place", "before"]), "suffix-ahead")
    left = right.repartitionByRange("head", "before", "doc_id", "place").sortWithinPartitions("head", "before", "doc_id", "place")
    both = left.mapInArrow(*_reach(left, "before", width, "back", ["doc_id", "place", "ahead"])).where(f"back + ahead >= {width}")
    return both.groupBy("doc_id").agg(F.collect_list(F.struct("place", "back", "ahead")).alias("reaches"))


def _windows(docs: DataFrame, candidates: DataFrame, length: int) -> DataFrame:
    """(w1, w2, doc_id, place, run, step) of the windows within the suffixes' reaches; ``run`` equal ones at equal steps are one row."""

    def each(words: C.Words, reaches: pa.Array, ids: np.ndarray) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(ids)), reaches.value_lengths().to_numpy())
        place, back, ahead = (reaches.flatten().field(i).to_numpy().astype(np.int64) for i in range(3))
        low = np.maximum(0, place - back)
        high = np.minimum(place - np.maximum(0, length - HEAD - ahead), words.count()[owner] - length)
        ok = low <= high
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, (words.first[owner] + low)[ok], 1)
        np.add.at(edge, (words.first[owner] + high)[ok] + 1, -1)
        grams, at = words.grams(length)
        asked = np.cumsum(edge)[at] > 0
        grams, at = grams[asked], at[asked]
        owner = words.text_of()[at]
        second = (C.mix(words.hash[at] + grams * C._P) ^ C.mix(words.hash[at + length - 1])) >> np.uint64(32)
        chosen, run, step = C.progressions(grams, at, owner)
        grams, second, at, owner = grams[chosen], second[chosen], at[chosen], owner[chosen]
        return pa.record_batch(
            [pa.array(C.signed(grams)), pa.array(second.astype(np.uint32).view(np.int32)), pa.array(ids[owner]), *[pa.array(x.astype(np.int32)) for x in (at - words.first[owner], run, step)]],
            names=["w1", "w2", "doc_id", "place", "run", "step"],
        )

    return _read(docs, candidates, "reaches", each, "w1 long, w2 int, doc_id long, place int, run int, step int", "suffix-windows")


def passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """Repeated passages: doc_id, start and end (word range), n_words, first (whether it is the occurrence to keep).

    A passage is a longest run of starts whose windows of ``length`` words occur again, in another document or
    in the same one; ``first`` holds where each window of the run is its first occurrence by (doc_id, place), so
    that rows of both kinds may overlap by part of a window. Of equal texts, the one of the smallest doc_id has a
    ``first`` row of all its words, besides rows for what it repeats of others; each other has one row of all words. Words are compared with A-Z lower-cased, whatever
    white space is between them. Null, empty and shorter texts have no passages. Rows with a null doc_id are
    ignored; rows that share a doc_id are one document, which doesn't repeat itself at one place. Extra columns aren't read.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    rows = _summaries(docs, length).where(f"words >= {length}")
    classes = rows.groupBy("words", "f1", "f2").agg(F.min("doc_id").alias("keep"), F.count_distinct("doc_id").alias("copies"))
    copied = rows.select("doc_id", "words", "f1", "f2").join(classes.where("copies > 1"), ["words", "f1", "f2"])
    whole = copied.select("doc_id", F.lit(0).alias("start"), F.col("words").alias("end"), F.expr("doc_id = keep").alias("first"))

    reps = rows.join(classes.select(F.col("keep").alias("doc_id")), "doc_id", "left_semi")
    suffixes = reps.select("doc_id", F.explode(F.arrays_zip("heads", "twice")).alias("s")).select("doc_id", "s.heads", "s.twice")
    paired = suffixes.groupBy("heads").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.max("twice").alias("twice")).where("a <> z or twice")
    matched = suffixes.join(paired.select("heads"), "heads").groupBy("doc_id").agg(F.collect_set("heads").alias("matched"))
    matched = C.cut(matched, "suffix-matches")
    suffixes = _suffixes(docs, matched, length)
    windows = _windows(docs, C.cut(_candidates(suffixes, length), "suffix-candidates"), length)
    again = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "place")).alias("f"), F.max(F.expr("struct(doc_id, place + (run - 1) * step as place)")).alias("z")).where("f <> z")
    hits = windows.join(again, ["w1", "w2"]).select("doc_id", "f", F.explode(F.expr("sequence(place, place + (run - 1) * step, step)")).alias("place"))
    hits = hits.select("doc_id", "place", F.expr("doc_id = f.doc_id and place = f.place").alias("first"))
    per_doc = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("place", "first"))).alias("h"))
    # a run ends where the next start isn't the next place, or is of the other kind
    at = lambda i, f: F.element_at("h", i)[f]
    breaks = F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: (i == 1) | (at(i, "place") != F.get("h", i - 2)["place"] + 1) | (at(i, "first") != F.get("h", i - 2)["first"]))
    runs = per_doc.withColumn("b", breaks).select("doc_id", "h", "b", F.posexplode("b").alias("i", "from"))
    until = F.coalesce(F.get("b", F.col("i") + 1) - 1, F.size("h"))
    found = runs.select("doc_id", at(F.col("from"), "place").alias("start"), (at(until, "place") + length).alias("end"), at(F.col("from"), "first").alias("first"))
    twice = copied.select("doc_id", F.lit(True).alias("twice"))
    out = found.join(twice, "doc_id", "left").where("twice is null or not first").drop("twice").unionByName(whole)
    return out.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), "first")


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with all passages cut out but the first occurrences; texts of which no word is left are dropped.

    Words inside a removed range go with the white space behind them; all else stays as it is. Texts that were
    null or empty before stay, and so do rows without a doc_id; rows that share a doc_id lose the same word ranges.
    """
    C.bound_batches(docs.sparkSession)
    doc_col, row_col, span_col = (C.free(docs, c) for c in ("repeat_doc", "repeat_row", "repeat_spans"))
    with C.passing(docs.sparkSession):
        spans = passages(docs, length).where("not first").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(span_col))
        spans = C.cut(spans, "repeats", keep=True).withColumnRenamed("doc_id", doc_col)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, spans in enumerate(batch.column(2)):
                if not spans.is_valid or texts[k] is None:
                    continue
                raw = texts[k].encode()
                words = C.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                gone = np.zeros(len(words), bool)
                for s in spans.as_py():
                    gone[s["start"] : s["end"]] = True
                if gone.all():
                    texts[k] = ""
                    continue
                edges = np.append(words.start, len(raw))
                keep = [raw[: edges[0]]] + [raw[edges[i] : edges[j]] for i, j in _runs(~gone)]
                texts[k] = b"".join(keep).decode()
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[row_col, "text"])

    names = docs.columns
    keyed = docs.join(spans, docs["doc_id"] == spans[doc_col], "left")
    changed = F.col(doc_col).isNotNull()
    rows = C.cut(keyed.withColumn(row_col, F.monotonically_increasing_id()), "trimming")
    new = rows.where(changed).select(row_col, "text", span_col).mapInArrow(trim, f"{row_col} long, text string")
    edited = rows.where(changed).drop("text").join(new, row_col).where("text <> ''").select(names)
    return rows.where(~changed).select(names).unionByName(edited)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
