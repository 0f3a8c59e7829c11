"""Hierarchical residual packing of token pieces into sequences of a fixed length.

Partitions pack their pieces by best fit, largest first, and emit nearly full bins. Underfull bins go on as
items: a few partitions' worth are merged into one for the next best-fit round, until one partition is left or
a round saves next to nothing (SAVES). Each round writes where a bin went (parent, offset); a piece's place is the sum along
the way. No partition of a round holds more than about ``PART_ITEMS`` items, since their number decides how
many partitions there are.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PART_ITEMS = 50_000
NEARLY_FULL = 4
"""Bins with at most so many free places are emitted without another round."""
SAVES = 0.001
"""Where several partitions are left, rounds go on while the last one saved this share of the open bins or more."""

_ENCODERS: dict[str, object] = {}


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, as it gives them without adding special tokens of its own.

    The file's vocabulary is loaded into a faster encoder that gives the same ids, since in such files a token's
    id is its merge rank. Texts that hold the text of an added token (which the library reads as that token), and
    texts on which the fast one gives up, are encoded by the tokenizers library itself, which is loaded when the
    first of them comes.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if model["normalizer"] is not None or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        self.path = path
        special = {t["id"] for t in model["added_tokens"]}
        self.added = [t["content"] for t in model["added_tokens"]]
        byte_of = self._bytes()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _bytes() -> dict[str, int]:
        """Byte-level vocabularies write a byte as its Latin-1 character if that is printable, else as one from U+0100 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        try:
            if not any(t in text for t in self.added):
                return np.array(self.fast.encode_ordinary(text), np.uint32)
        except BaseException as e:  # the Rust side panics on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (of the little-endian uint32 ids) and, if asked, ids.

    A document is its text's ids, then ``end_id``; a null text counts as empty. Only documents longer than
    ``length`` are cut, into pieces of that length of which the first may be shorter.
    """

    C.bound_batches(docs.sparkSession)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for k, text in enumerate(part.column(1)):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    bounds = [0, *range((len(ids) - 1) % length + 1, len(ids) + 1, length)]
                    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        for x, y in zip(rows, (k, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b]), strict=True):
                            x.append(y)
                columns = [part.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:5]]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype(np.int32) for x in rows[5]], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.record_batch(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest first, each item into the fullest bin that takes it: (bin of each item, offset there, fill of each bin)."""
    bins, offsets, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r places left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def _round(items: DataFrame, capacity: int, parts: int, number: int) -> DataFrame:
    """One best-fit round over ``parts`` partitions of (id, size): (id, size, parent, offset, fill)."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id"], ascending=[False, True], kind="stable")
        bins, offsets, fills = best_fit(rows["size"].to_numpy(), capacity)
        parent = (number << 56) + (int(key[0]) << 24) + bins
        return pd.DataFrame({"id": rows["id"].to_numpy(), "size": rows["size"].to_numpy(), "parent": parent, "offset": offsets, "fill": fills[bins]})

    group = items.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(parts)))
    return group.groupBy("g").applyInPandas(pack, "id long, size long, parent long, offset long, fill long")


def pack(items: DataFrame, capacity: int, part_items: int = PART_ITEMS) -> DataFrame:
    """(id, sequence_id, offset) of (id, size) with unique ids and sizes from 1 to ``capacity``."""
    open_items, done, number, before = items.select("id", "size"), None, 0, None
    while True:
        n = open_items.count()
        if n == 0:
            break
        parts = max(1, -(-n // part_items))
        placed = C.cut(_round(open_items, capacity, parts, number + 1), "packing-round")
        here = placed.select("id", "parent", "offset", "fill")
        done = here if done is None else C.cut(
            done.where("closed").drop("closed").unionByName(
                done.where("not closed").drop("closed", "fill").join(here.select(F.col("id").alias("parent"), F.col("parent").alias("p"), F.col("offset").alias("o"), "fill"), "parent")
                .select("id", F.col("p").alias("parent"), (F.col("offset") + F.col("o")).alias("offset"), "fill")), "packing-places")
        number += 1
        full = F.col("fill") >= capacity - NEARLY_FULL
        bins = placed.groupBy("parent").agg(F.first("fill").alias("fill"))
        left = C.cut(bins.where(~full).select(F.col("parent").alias("id"), F.col("fill").alias("size")), "packing-open")
        m = left.count()
        last = parts == 1 or (before is not None and m > (1 - SAVES) * before)
        if last or m == 0:
            done = done.withColumn("closed", F.lit(True))
            break
        done, open_items, before = done.withColumn("closed", full), left, m
    if done is None:
        return items.select("id", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return done.select("id", F.col("parent").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, part_items: int = PART_ITEMS) -> DataFrame:
    """All documents in sequences of at most ``length`` tokens: a row per piece, as ``pieces`` has them, with sequence_id and offset.

    Nulls: a null text is the end id alone; a null doc_id is kept as it is. Rows that repeat are packed as often
    as they occur. An empty table gives no rows. Columns besides doc_id and text are not read.
    """
    found = C.cut(pieces(docs, tokenizer, length).withColumn("id", F.monotonically_increasing_id()), "pieces")
    whole = found.where(f"length = {length}").withColumns({"sequence_id": -1 - F.col("id"), "offset": F.lit(0).cast("long")})
    rest = found.where(f"length < {length}")
    placed = pack(rest.select("id", F.col("length").alias("size")), length, part_items)
    return whole.unionByName(rest.join(placed, "id")).drop("id")
