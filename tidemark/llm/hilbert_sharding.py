"""Hilbert-curve ordering: quantise metadata, sort by curve index, cut runs into shards. DataFrame functions only.

Rows that are near in several dimensions at once land in the same shard, so a reader with a predicate on any
of them skips most shards. The curve's cells are few (2 ** (dims * BITS)), whatever the input's size; their
histogram is the only thing that is broadcast. A cell with many rows is split into sub-cells of about
``CELL_ROWS`` rows by a hash of the id, so no task sorts more than such a sub-cell at a time.

Law ``rows``: shard i holds the ranks from floor(i*n/shards) on, so counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 5
CELL_ROWS = 1_000


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of the cell with ``coords``, integers of ``bits`` bits each, as a long.

    The coordinates' bits are taken from the top down. Per level, an array state holds the coordinates after the
    exchanges and inversions that the levels above ask for; a Gray decoding turns the result into the index.
    """
    n = len(coords)
    axes = F.array(*[c.cast("long") for c in coords])

    def turn(x: Column, q: Column, i: int) -> Column:
        """Where axis i has bit q: invert the first axis below q; else exchange its low bits with the first axis."""
        first, mine, low = F.element_at(x, 1), F.element_at(x, i + 1), q - 1
        swapped = first.bitwiseXOR(mine).bitwiseAND(low)
        inverted = F.array(first.bitwiseXOR(low), *[F.element_at(x, k + 1) for k in range(1, n)])
        if i == 0:
            exchanged = x
        else:
            exchanged = F.array(first.bitwiseXOR(swapped), *[F.element_at(x, k + 1).bitwiseXOR(swapped) if k == i else F.element_at(x, k + 1) for k in range(1, n)])
        return F.when(mine.bitwiseAND(q) != 0, inverted).otherwise(exchanged)

    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]
    # one lambda for all steps: the axis is chosen by its number, so the expression doesn't grow with the levels
    turned = F.aggregate(
        F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps]),
        axes,
        lambda x, s: F.coalesce(*[F.when(s["i"] == i, turn(x, s["q"], i)) for i in range(n)]),
    )
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.array(F.element_at(turned, 1)), lambda x, k: F.concat(x, F.array(F.element_at(turned, k + 1).bitwiseXOR(F.element_at(x, -1))))) if n > 1 else turned
    flip = F.aggregate(
        F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]),
        F.lit(0).cast("long"),
        lambda t, q: F.when(F.element_at(gray, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
    )
    return F.aggregate(
        F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)]),
        F.lit(0).cast("long"),
        lambda h, s: h * 2 + F.call_function("getbit", F.element_at(gray, s["i"] + 1).bitwiseXOR(flip), s["b"]),
    )


def _log_bucket(size: Column, bits: int) -> Column:
    """Two buckets for each doubling of ``size``, from 16 on."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor(2 * F.log2(F.greatest(size, F.lit(16)) / 16)))).cast("int")


def _hash_bucket(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))), F.lit(1 << bits)).cast("int")


def order(rows: DataFrame, coords: list[Column], ident: Column, bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve`` (Hilbert index), ``rank`` (place in curve order from 0, ties by ident) and ``total``."""
    if len(coords) * bits > 16:
        raise ValueError("more than 65,536 cells: their histogram would be too large to broadcast")
    names = [f"__c{i}" for i in range(len(coords))]
    found = rows.withColumns(dict(zip(names, coords, strict=True))).withColumn("__id", F.xxhash64(ident))
    cells = found.groupBy(*names).agg(F.count("*").alias("__n"))
    cells = cells.withColumn("curve", hilbert_index([F.col(c) for c in names], bits)).withColumn("__parts", F.ceil(F.col("__n") / CELL_ROWS))
    # written, or the optimiser would compute the index row by row below the histogram; at most 2 ** 16 rows
    cells = F.broadcast(cut(cells.select(*names, "curve", "__parts"), "cells"))
    found = found.join(cells, names).withColumn("__sub", F.pmod("__id", "__parts"))

    # ranks: rows before the cell, rows before the sub-cell in its cell, place in the sub-cell
    subs = cut(found.groupBy("curve", "__sub").agg(F.count("*").alias("__n")), "sub-cells")
    block = F.shiftright("curve", bits)
    in_cell = subs.withColumn("__before", F.sum("__n").over(Window.partitionBy("curve").orderBy("__sub")) - F.col("__n"))
    by_cell = subs.groupBy("curve").agg(F.sum("__n").alias("__n")).withColumn("__block", block)
    by_block = by_cell.groupBy("__block").agg(F.sum("__n").alias("__n"))
    up_to = Window.orderBy("__block")  # at most 2 ** (16 - bits) rows
    by_block = by_block.select("__block", (F.sum("__n").over(up_to) - F.col("__n")).alias("__blocks"), F.sum("__n").over(Window.partitionBy()).alias("total"))
    by_cell = by_cell.withColumn("__cells", F.sum("__n").over(Window.partitionBy("__block").orderBy("curve")) - F.col("__n"))
    base = by_cell.drop("__n").join(F.broadcast(by_block), "__block").select("curve", "total", (F.col("__blocks") + F.col("__cells")).alias("__base"))
    starts = in_cell.drop("__n").join(F.broadcast(base), "curve").select("curve", "__sub", "total", (F.col("__base") + F.col("__before")).alias("__start"))
    place = F.row_number().over(Window.partitionBy("curve", "__sub").orderBy("__id", *[c for c in rows.columns]))
    ranked = found.withColumn("__place", place).join(starts, ["curve", "__sub"])
    return ranked.select(*rows.columns, "curve", (F.col("__start") + F.col("__place") - 1).alias("rank"), "total")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document: doc_id, lang, source, size, text_crc32, curve, rank, shard, slot.

    size: UTF-8 bytes of the text plus 1 (null: 1); text_crc32 of a null text is that of the empty one. The
    dimensions are size (on a log scale), lang and source; nulls in them count as empty. Rows are ordered by
    curve index, then by a hash of doc_id, then by all their values, so repeated rows differ in nothing that
    matters. An empty table gives no rows. Only the named columns are read; extra ones are left out.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", "lang", "source", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    ranked = order(rows, [_log_bucket(F.col("size"), BITS), _hash_bucket(F.col("source"), BITS), _hash_bucket(F.col("lang"), BITS)], F.col("doc_id"))
    number = F.expr(f"((rank + 1) * {shards} - 1) div total")
    return ranked.withColumn("shard", number.cast("int")).withColumn("slot", F.expr(f"rank - (shard * total) div {shards}")).drop("total")
