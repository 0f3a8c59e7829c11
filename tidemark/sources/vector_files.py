"""Binary vector files: .bin (header and rows), truth sets, fvecs/bvecs/ivecs, npy.

Readers are Spark data sources: ``spark.read.format("vectors")`` splits a file into ranges of rows that tasks read
by offset, so a large file is neither loaded at once nor by one task. Paths must be files that all executors see.
"""

from __future__ import annotations

import glob
import os
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ELEMENTS = {"float": np.dtype("<f4"), "int8": np.dtype("i1"), "uint8": np.dtype("u1"), "int32": np.dtype("<i4")}
ROWS_PER_SPLIT = 100_000
_SQL = {"float": "array<float>", "int8": "array<tinyint>", "uint8": "array<smallint>", "int32": "array<int>"}
_ARROW = {"float": pa.float32(), "int8": pa.int8(), "uint8": pa.int16(), "int32": pa.int32()}


def metadata(path: str, offset: int = 0) -> tuple[int, int]:
    """(rows, dim) from a .bin header."""
    with open(path, "rb") as f:
        f.seek(offset)
        head = np.frombuffer(f.read(8), "<u4")
    if len(head) < 2:
        raise ValueError(f"{path} has no header")
    return int(head[0]), int(head[1])


def read_bin(path: str, element: str = "float", offset: int = 0) -> np.ndarray:
    """A whole .bin section as a matrix; a section may begin at any byte of the file."""
    rows, dim = metadata(path, offset)
    data = np.fromfile(path, ELEMENTS[element], rows * dim, offset=offset + 8)
    if len(data) < rows * dim:
        raise ValueError(f"{path} is truncated: {len(data)} of {rows * dim} values")
    return data.reshape(rows, dim)


def write_bin(path: str, matrix: np.ndarray, element: str = "float") -> None:
    with open(path, "wb") as f:
        np.array(matrix.shape, "<u4").tofile(f)
        np.ascontiguousarray(matrix, ELEMENTS[element]).tofile(f)


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__(low)
        self.low, self.high = low, high


class VectorSource(DataSource):
    """Format ``vectors``. Options: path, kind (bin, fvecs, bvecs, ivecs), element, id (column name), offset."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def _element(self) -> str:
        kind = self.options.get("kind", "bin")
        return {"fvecs": "float", "bvecs": "uint8", "ivecs": "int32"}.get(kind) or self.options.get("element", "float")

    def schema(self) -> str:
        return f"{self.options.get('id', 'vec_id')} long, embedding {_SQL[self._element()]}"

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(self.options, self._element())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _VectorWriter(self.options, self._element(), [f.name for f in schema.fields])


class _VectorReader(DataSourceReader):
    def __init__(self, options, element: str):
        self.path, self.element, self.kind = options["path"], element, options.get("kind", "bin")
        self.offset, self.id = int(options.get("offset", 0)), options.get("id", "vec_id")
        size = ELEMENTS[element].itemsize
        if self.kind == "bin":
            self.rows, self.dim = metadata(self.path, self.offset)
            self.start, self.stride, self.skip = self.offset + 8, self.dim * size, 0
        else:  # each row has its length before it
            self.dim = int(np.fromfile(self.path, "<u4", 1)[0])
            self.start, self.stride, self.skip = 0, 4 + self.dim * size, 4
            self.rows = os.path.getsize(self.path) // self.stride
        if os.path.getsize(self.path) < self.start + self.rows * self.stride:
            raise ValueError(f"{self.path} is truncated")

    def partitions(self) -> list[_Rows]:
        return [_Rows(a, min(self.rows, a + ROWS_PER_SPLIT)) for a in range(0, max(1, self.rows), ROWS_PER_SPLIT)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        for a in range(partition.low, partition.high, 10_000):
            b = min(partition.high, a + 10_000)
            raw = np.fromfile(self.path, np.uint8, (b - a) * self.stride, offset=self.start + a * self.stride).reshape(b - a, self.stride)
            x = np.ascontiguousarray(raw[:, self.skip :]).view(ELEMENTS[self.element]).reshape(-1)
            offsets = np.arange(b - a + 1, dtype=np.int32) * self.dim
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x).cast(_ARROW[self.element]))
            yield pa.record_batch([pa.array(np.arange(a, b)), lists], names=[self.id, "embedding"])


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None, rows: int, dim: int, first: int):
        self.path, self.rows, self.dim, self.first = path, rows, dim, first


class _VectorWriter(DataSourceWriter):
    """Tasks write headerless parts beside the target; the commit joins them by their first id behind one header."""

    def __init__(self, options, element: str, names: list[str]):
        self.path, self.element, self.id = options["path"], element, next(n for n in names if n != "embedding")

    def write(self, rows) -> _Written:
        found = sorted((r[self.id], r["embedding"]) for r in rows)
        if not found:
            return _Written(None, 0, 0, 0)
        part = f"{self.path}.part-{found[0][0]}-{os.getpid()}"
        np.array([v for _, v in found], ELEMENTS[self.element]).tofile(part)
        return _Written(part, len(found), len(found[0][1]), found[0][0])

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m and m.path), key=lambda m: m.first)
        with open(self.path, "wb") as f:
            np.array([sum(m.rows for m in parts), parts[0].dim if parts else 0], "<u4").tofile(f)
            for m in parts:
                with open(m.path, "rb") as g:
                    while block := g.read(1 << 24):
                        f.write(block)
                os.remove(m.path)

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


def vectors(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """vec_id, embedding of a vector file; vec_id is the row's place."""
    spark.dataSource.register(VectorSource)
    return spark.read.format("vectors").options(path=path, **options).load()


def save_vectors(df: DataFrame, path: str, element: str = "float") -> None:
    """Write (id, embedding) as .bin in id order; parts are ranges of ids, so that no task has all rows."""
    df.sparkSession.dataSource.register(VectorSource)
    df.repartitionByRange(df.columns[0]).write.format("vectors").option("element", element).mode("append").save(path)


def truth(spark: SparkSession, path: str) -> DataFrame:
    """query_id, rnk, neighbor_id, dist of a truth set: header, all ids, all distances."""
    n, k = metadata(path)
    if os.path.getsize(path) < 8 + 8 * n * k:
        raise ValueError(f"{path} is truncated")
    ids = np.memmap(path, "<u4", "r", 8, (n, k))
    dists = np.memmap(path, "<f4", "r", 8 + 4 * n * k, (n, k))
    columns = [np.repeat(np.arange(n), k), np.tile(np.arange(1, k + 1), n), ids.reshape(-1).astype(np.int64), dists.reshape(-1).astype(float)]
    return spark.createDataFrame(pa.table(list(map(pa.array, columns)), names=["query_id", "rnk", "neighbor_id", "dist"]))


def save_truth(df: DataFrame, path: str) -> None:
    """Write (query_id, rnk, neighbor_id, dist) as a truth set; rows go through the driver one partition at a time."""
    n, k = df.agg({"query_id": "max", "rnk": "max"}).first()
    with open(path, "wb") as f:
        np.array([n + 1, k], "<u4").tofile(f)
        f.truncate(8 + 8 * (n + 1) * k)
    ids, dists = np.memmap(path, "<u4", "r+", 8, (n + 1, k)), np.memmap(path, "<f4", "r+", 8 + 4 * (n + 1) * k, (n + 1, k))
    for r in df.toLocalIterator():
        ids[r.query_id, r.rnk - 1], dists[r.query_id, r.rnk - 1] = r.neighbor_id, r.dist
    ids.flush()
    dists.flush()


def convert_vecs(source: str, target: str, kind: str) -> tuple[int, int]:
    """fvecs, bvecs or ivecs to .bin: (rows, dim)."""
    element = {"fvecs": "float", "bvecs": "uint8", "ivecs": "int32"}[kind]
    dim = int(np.fromfile(source, "<u4", 1)[0])
    raw = np.memmap(source, np.uint8, "r").reshape(-1, 4 + dim * ELEMENTS[element].itemsize)
    write_bin(target, np.ascontiguousarray(raw[:, 4:]).view(ELEMENTS[element]), element)
    return len(raw), dim


def convert_npy(pattern: str, target: str, element: str = "float") -> tuple[int, int]:
    """npy files, in sorted order, to one .bin."""
    parts = [np.load(p, mmap_mode="r") for p in sorted(glob.glob(pattern))]
    if not parts or any(p.ndim != 2 or p.shape[1] != parts[0].shape[1] for p in parts):
        raise ValueError(f"{pattern}: no two-dimensional files of one width")
    rows = sum(len(p) for p in parts)
    with open(target, "wb") as f:
        np.array([rows, parts[0].shape[1]], "<u4").tofile(f)
        for p in parts:
            np.ascontiguousarray(p, ELEMENTS[element]).tofile(f)
    return rows, parts[0].shape[1]


class _Plain(pickle.Unpickler):
    """Pickles of lists, dicts and numpy arrays only."""

    def find_class(self, module: str, name: str):
        if module.split(".")[0] == "numpy":
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} isn't allowed")


def import_truth(path: str, base_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, ids, scores) of a pickled list of {payload, gt_ids, gt_scores}; ids must lie in the base."""
    with open(path, "rb") as f:
        rows = _Plain(f).load()
    queries, ids, scores = (np.array([r[k] for r in rows]) for k in ("payload", "gt_ids", "gt_scores"))
    if ids.min(initial=0) < 0 or ids.max(initial=0) >= base_rows:
        raise ValueError("a true neighbour isn't in the base")
    return queries, ids, scores
