"""Vector expressions: built-in array functions (text: an Arrow function), evaluated in double precision, left to right."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")
INTEGER_TYPES = ("int8", "uint8")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; the largest float if a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(3.4028234663852886e38)).otherwise(1 - dot(a, b) / norms)


def distance(metric: str, a: Column, b: Column, element: str = "float") -> Column:
    """The expression of a metric; inner product isn't defined for integer elements."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if metric == "ip":
        if element in INTEGER_TYPES:
            raise ValueError("inner product needs float elements")
        return -dot(a, b)
    return l2(a, b) if metric == "l2" else cosine(a, b)


def _cosine_block(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
        return np.where(norms == 0, 3.4028234663852886e38, 1 - q @ v.T / norms)


def _l2_block(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T)


def _l2_expanded_block(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distance by norms and inner product, clamped at 0. Where norms and product cancel all but a thousandth, or aren't finite, the difference is taken instead."""
    with np.errstate(all="ignore"):
        squared, norms = _l2_block(q, v), (v * v).sum(1)
        for i, x in enumerate(q):
            near = np.flatnonzero(~(squared[i] > 1e-3 * (x @ x + norms)))
            squared[i, near] = ((v[near] - x) ** 2).sum(1)
        return np.sqrt(np.maximum(0.0, squared))


BLOCKWISE = {"cosine": _cosine_block, "l2_integer": _l2_block, "l2_expanded": _l2_expanded_block}
"""Distances of all rows of a matrix to all rows of another; cosine is the expression above but for the order of sums.
l2_integer, squared, is exact for components that are integers, since no sum is rounded."""


def normalize(v: Column) -> Column:
    """Unit length, the norm guarded by the float epsilon."""
    n = F.sqrt(dot(v, v) + 1.1920928955078125e-07)
    return F.transform(doubles(v), lambda x: x / n)


def lerp(a: Column, b: Column, weight: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: (1 - weight) * x + weight * y)


def to_int8(v: Column, scale: float = 127.0) -> Column:
    return F.transform(doubles(v), lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.round(x * scale))).cast("int"))


def to_text(v: Column) -> Column:
    """``[a,b,...]`` with six decimals, rounded as C's printf does: by the exact binary value, ties to even. Java's formatter takes ties up."""

    def text(vectors: pa.Array) -> pa.Array:
        return pa.array((None if x is None else "[" + ",".join(["null" if y is None else "%.6f" % y for y in x]) + "]" for x in vectors.to_pylist()), pa.string())

    return F.arrow_udf(text, "string")(doubles(v))


def from_text(s: Column) -> Column:
    """The vector of a text; ``nan`` and ``inf`` as C and Python write them, or as JSON readers take them."""
    return F.from_json(F.regexp_replace(F.regexp_replace(s, "nan", "NaN"), "inf", "Infinity"), "array<float>")


def valid(v: Column, dim: int) -> Column:
    """Whether the vector has ``dim`` finite components."""
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def region_key(v: Column, dims: int, buckets: int, low: float, high: float) -> Column:
    """Buckets of the first ``dims`` coordinates of a basis where ``v`` lies; 0 if the range is empty."""
    if high == low:
        return F.transform(F.slice(v, 1, dims), lambda x: F.lit(0))
    return F.transform(F.slice(doubles(v), 1, dims), lambda x: F.least(F.lit(buckets - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))) * buckets)).cast("int"))


def l1_keys(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def fnv1a(value: Column) -> Column:
    """FNV-1a over the eight octets of a non-negative long, as decimal(20,0): its modulus is 2**64, beyond a long."""
    # fixed values: offset basis, prime, modulus
    basis, prime, modulus = "14695981039346656037", 1099511628211, "18446744073709551616"
    low = F.lit("4294967296").cast("decimal(38,0)")
    octets = F.transform(F.sequence(F.lit(0), F.lit(56), F.lit(8)), lambda i: F.call_function("shiftright", value, i).bitwiseAND(255).cast("int"))

    def step(state: Column, octet: Column) -> Column:
        low_byte = F.call_function("mod", state, F.lit(256).cast("decimal(38,0)")).cast("int")
        mixed = (state - low_byte + low_byte.bitwiseXOR(octet)).cast("decimal(20,0)")
        # (hi * 2**32 + lo) * prime, modulo 2**64, without leaving 38 digits
        top = F.floor(mixed / low).cast("decimal(12,0)")
        rest = (mixed - top * low).cast("decimal(12,0)")
        top_part = F.call_function("mod", (top * F.lit(prime).cast("decimal(14,0)")).cast("decimal(38,0)"), low).cast("decimal(12,0)")
        value = top_part * low.cast("decimal(12,0)") + rest * F.lit(prime).cast("decimal(14,0)")
        return F.call_function("mod", value.cast("decimal(38,0)"), F.lit(modulus).cast("decimal(38,0)")).cast("decimal(38,0)")

    return F.aggregate(octets, F.lit(basis).cast("decimal(38,0)"), step).cast("decimal(20,0)")


def check_identifier(name: str) -> str:
    """A table or column name as SQL connectors accept it."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name
