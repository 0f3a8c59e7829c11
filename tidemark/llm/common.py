"""Shared parts of the training-data operators: durable cuts, word hashing on Arrow buffers, components.

Word hashing works on the bytes of a whole Arrow batch at once, so a text costs a few vector passes and
no Python loop per word. Words are runs of bytes outside ``\\x20\\x09-\\x0D``; A-Z are lower-cased.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 18
"""Texts are hashed in chunks of about so many bytes; this bounds the per-byte work arrays."""

_OWN_DIR: dict[str, str] = {}


def _give_back() -> None:
    """Have what is freed go back to the system: a worker's memory then follows what it holds, not the most it ever held.

    Arrow allocates by malloc, and malloc maps blocks of 4 MB or more apart. Without glibc nothing is changed.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        option = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    # fixed values of malloc.h: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
    for name, value in ((-3, 4 << 20), (-1, 8 << 20), (-8, 2)):
        option(name, value)


_give_back()


BATCH_BYTES = 4 << 20
"""Rows go to Python in batches of about so many bytes: by count alone, a batch grows with the length of the texts."""


READ_ROWS = 1024
"""Rows a Parquet reader decodes at a time: its arrays grow with the texts in them and by doubling, and more live at once in the heap."""


def bound_batches(spark: SparkSession) -> None:
    """Have this session's Arrow batches end at BATCH_BYTES and its Parquet batches at READ_ROWS, where its own bounds aren't smaller.

    The session keeps the settings, since plans are made when their result is asked for. Results don't depend on them.
    """
    for name, bound in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(name, None) or "")
        if now is None or int(now[1]) > bound:
            spark.conf.set(name, str(bound))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where it is unset and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _OWN_DIR[app]


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES: list[list[str]] = []


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What an action in this block shuffled goes when the action ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Cuts made in this block are deleted at its end, but for those that are to be kept: only these may be read later."""
    _SCOPES.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _SCOPES.pop()):
            path.getFileSystem(conf).delete(path, True)


def _place(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder, which the block of ``passing`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    outer = _SCOPES[:-1] if keep else _SCOPES
    if outer:
        outer[-1].append(path)
    return path


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends in replicated files; ``keep``: beyond the block of ``passing``."""
    path = _place(df.sparkSession, name, keep)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str) -> DataFrame:
    """The ``cut`` of ``df.mapInArrow(run, schema)``; if the shared folder is a mounted one (file:), the Python workers write its files themselves.

    There Hadoop's writer starts three ``chmod`` a file, each of which has its whole executor's memory for its own until
    it is under way; and rows needn't go back to the JVM only to be written. A file gets its name when it is whole, the
    same one from each attempt of its task. Other file systems get theirs from Spark's writer.
    """
    spark, path = df.sparkSession, _place(df.sparkSession, name)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        with cleaned(spark):
            df.mapInArrow(run, schema).write.parquet(path)
        return spark.read.schema(schema).parquet(path)
    folder = place.toUri().getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, writer, rows = f"{folder}/.{task.partitionId()}-{task.taskAttemptId()}", None, 0
        try:
            for group in _gathered(run(batches)):
                writer = writer or pq.ParquetWriter(part, group.schema)
                writer.write_table(group, row_group_size=group.num_rows)
                rows += group.num_rows
            if writer is not None:
                writer.close()
                os.replace(part, f"{folder}/part-{task.partitionId():05d}.parquet")
        finally:
            if writer is not None:
                writer.close()
                with suppress(FileNotFoundError):
                    os.remove(part)
        yield pa.record_batch([pa.array([rows], pa.int64())], names=["rows"])

    os.makedirs(folder)
    with cleaned(spark):
        df.mapInArrow(write, "rows long").write.format("noop").mode("overwrite").save()
    return spark.read.schema(schema).parquet(path)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """All rows of ``batches``, as tables of about BATCH_BYTES."""
    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.nbytes
        if size >= BATCH_BYTES:
            yield pa.Table.from_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def free(df: DataFrame, name: str) -> str:
    """``name``, or the like, that isn't a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a doc_id in every row, and the name of an added column that tells which had none.

    A row without one is named by a hash of its values, from 2**62 on: equal rows are one document, and rows that
    came with an id are the smaller ones.
    """
    lacks = free(docs, "lacks_id")
    made = F.shiftrightunsigned(F.xxhash64(*[c for c in docs.columns if c != "doc_id"]), 2) + F.lit(1 << 62)
    return docs.withColumn(lacks, F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", made)), lacks


def restored(docs: DataFrame, lacks: str) -> DataFrame:
    """The rows of ``identified`` with the ids they came with."""
    return docs.withColumn("doc_id", F.when(~F.col(lacks), F.col("doc_id"))).drop(lacks)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (one column, any name); columns stay as they are."""
    gone = free(docs, "gone")
    return docs.join(ids.toDF(gone), docs["doc_id"] == F.col(gone), "left_anti")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- word hashes on Arrow buffers -------------------------------------------------------------

_U = np.uint64
_P, _Q = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _inverse(x: np.uint64) -> np.uint64:
    return _U(pow(int(x), -1, 1 << 64))


def _byte_table() -> np.ndarray:
    table = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_BYTES = _byte_table()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept for the next call."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 12
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of the result depend on all bits of x."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Of each range the polynomial sum of values with rising powers of base, whatever the range's place."""
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(_inverse(base), len(values) + 1)[starts]


class Words:
    """The words of a block of texts: ``hash`` (uint64), byte ``start`` and ``end``, and ``first``: of text i the words first[i]:first[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = ~_SPACE[data]
        before, after = np.empty_like(word), np.empty_like(word)
        if len(word):
            before[0], before[1:] = False, word[:-1]
            after[-1], after[:-1] = False, word[1:]
            full = offsets[:-1][offsets[1:] > offsets[:-1]]
            before[full] = False
            after[full[1:] - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i, n = 0, len(self.start)
        while i < n:  # one step unless a single text is longer than a chunk
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + 2 * CHUNK_BYTES, "right")))
            a, b = int(self.start[i]), int(self.end[j - 1])
            out[i:j] = _window_sums(_BYTES[self.data[a:b]], self.start[i:j] - a, self.end[i:j] - a, _P)
            i = j
        return mix(out)

    def __len__(self) -> int:
        return len(self.start)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Of each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.count())

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, positions) of all n consecutive words within one text."""
        if len(self.hash) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(np.arange(len(self.hash)) + n <= np.repeat(self.first[1:], self.count()))
        if n <= 8:
            out = np.zeros(len(at), np.uint64)
            for k, p in enumerate(powers(_Q, n)):
                out += self.hash[at + k] * p
            return mix(out), at
        return mix(_window_sums(self.hash, at, at + n, _Q)), at


def blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about CHUNK_BYTES; a null counts as empty."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK_BYTES, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """An Arrow list column: row i holds values[bounds[i]:bounds[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of x[i:i+width] for each i with a whole window, by doubling."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def window_minima(hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of ``window`` hashes the smallest, and whether the run lies in one text (``at``: word places, with gaps between texts)."""
    least = sliding(hashes, window, np.minimum)
    return least, at[window - 1 :] - at[: len(least)] == window - 1


def minima(hashes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Which hashes are the smallest of some window of their text."""
    if len(hashes) < window:
        return np.zeros(len(hashes), bool)
    least, whole = window_minima(hashes, at, window)
    edge = np.zeros(window - 1, np.uint64)
    return sliding(np.concatenate([edge, np.where(whole, least, np.uint64(0)), edge]), window, np.maximum) == hashes


PERIOD = 32
"""Equal keys at most so many words apart are taken for a text that says the same thing over and over."""


def progressions(keys: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys of one text at equal steps of up to PERIOD as one: (index of the first of each, how many, step, 1 for single ones)."""
    order = np.lexsort((at, keys, owner))
    k, a, o = keys[order], at[order], owner[order]
    step = np.zeros(len(k), np.int64)  # to the one before, 0 if that is another key or too far
    near = (k[1:] == k[:-1]) & (o[1:] == o[:-1]) & (a[1:] - a[:-1] <= PERIOD)
    step[1:] = np.where(near, a[1:] - a[:-1], 0)
    new = np.ones(len(k), bool)
    new[1:] = (step[1:] == 0) | (step[1:] != step[:-1]) & (step[:-1] != 0)
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(k)))
    after = step[np.minimum(begin + 1, len(k) - 1)] if len(k) else step
    return order[begin], run, np.where(run > 1, after, 1)


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's words in their order."""
    rank = (np.arange(len(words)) - np.repeat(words.first[:-1], words.count())).astype(np.uint64)
    out = []
    for salt in (_P, _Q):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hash + (rank + np.uint64(1)) * salt))])
        out.append(signed(sums[words.first[1:]] - sums[words.first[:-1]]))
    return out[0], out[1]


# --- a bounded filter of ids ------------------------------------------------------------------

FILTER_BITS = 1 << 28
"""The largest filter that travels to the tasks (32 MB)."""


def only(docs: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ("text",)) -> tuple[DataFrame, object]:
    """Rows of ``docs`` (doc_id, ``columns``) that may be in ``ids`` (doc_id): (frame, keep).

    ``keep(batch)`` drops what a Bloom filter rules out, within the Python step that reads the batch, so texts
    needn't be shuffled. The filter has 16 bits and two marks an id, FILTER_BITS at most; beyond that many ids
    the frame is semi-joined instead. A row that isn't in ``ids`` may stay: callers join by doc_id afterwards.
    """
    bits = 1 << max(13, int(16 * max(1, ids.count()) - 1).bit_length())
    if bits > FILTER_BITS:
        return docs.select("doc_id", *columns).join(ids, "doc_id", "left_semi"), lambda batch: batch
    width, key = max(1 << 13, bits >> 4), F.xxhash64("doc_id")
    places = F.array(F.pmod(key, F.lit(bits)), F.pmod(F.shiftrightunsigned(key, 32), F.lit(bits)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for i in np.unique(at // width):
                marked.setdefault(int(i), np.zeros(width, bool))[at[at // width == i] % width] = True
        if marked:
            yield pa.record_batch([pa.array(list(marked), pa.int32()), pa.array([np.packbits(x).tobytes() for x in marked.values()], pa.binary())], names=["slice", "bits"])

    whole = np.zeros(bits // 8, np.uint8)
    with cleaned(docs.sparkSession):  # collected in one job; an iterator runs one for each partition
        slices = ids.select(F.explode(places).alias("at")).repartition(bits // width, (F.col("at") / width).cast("int")).mapInArrow(mark, "slice int, bits binary").collect()
    for row in slices:
        whole[row.slice * width // 8 : (row.slice + 1) * width // 8] |= np.frombuffer(row.bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(whole)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashed, stays = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64), True
        for shift in (0, 32):
            at = ((hashed >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64)
            stays = stays & (sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return batch.filter(pa.array(stays))

    return docs.select("doc_id", *columns, key.alias("hashed")).where("doc_id is not null"), keep


# --- connected components ---------------------------------------------------------------------


def _stars(e: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none itself."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("c").alias("c"), F.max("p").alias("p")).where("c > 1 or c = 1 and p = 1").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): each node of ``edges`` (a, b) with the smallest node that it reaches.

    Alternates large-star and small-star steps until only stars are left; each round is written to the shared
    folder. Only per-node minima and equi-joins, so no group is gathered in one task.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        low = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        # each node with its smallest neighbour, and that neighbour with the node's others
        pair = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        e = cut(low.join(least, "u").select(F.explode(pair).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), name)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
