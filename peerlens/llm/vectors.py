"""Vectors of exact integers, sums over tasks of any number, and arithmetic with twice the digits of a double."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries from here on don't count as finite: their integers, and differences of these, wouldn't fit into 64 bits.
FINITE = float(1 << 61)
DECIMAL = "decimal(38,0)"


def integers(vector: Column, scale: int) -> Column:
    """array<bigint> floor(scale * entry), the entry as double; null for a vector that is null, empty, or holds a null, an infinity, NaN or an entry beyond FINITE."""
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    good = F.forall(vector, lambda x: F.coalesce(F.abs(scaled(x)) < F.lit(FINITE), F.lit(False)))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & good, F.transform(vector, lambda x: F.floor(scaled(x))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's lists of longs, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact(x: np.ndarray, bound: int) -> np.ndarray:
    """x as it is if numbers up to the bound fit into 64 bits, else as Python's integers."""
    return x if bound < 1 << 62 else x.astype(object)


def largest(x: np.ndarray) -> int:
    return int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0


def long_or_none(x: np.ndarray) -> pa.Array:
    """int64; null where a number doesn't fit."""
    return pa.array(x, pa.int64()) if x.dtype != object else pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in x], pa.int64())


def column_sums(x: np.ndarray) -> list[int]:
    return [int(v) for v in exact(x, largest(x) * max(len(x), 1)).sum(axis=0)] if len(x) else [0] * x.shape[1]


def as_decimals(x: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in x], pa.decimal128(38, 0))


Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and what rounding took away."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a: np.ndarray) -> Pair:
    """Two halves of a double's digits, so that products of halves are exact."""
    c = a * 134217729.0
    high = c - (c - a)
    return high, a - high


def two_prod(a: np.ndarray, b: np.ndarray, halves_a: Pair, halves_b: Pair) -> Pair:
    """The rounded product and what rounding took away."""
    p, (ah, al), (bh, bl) = a * b, halves_a, halves_b
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(x: Pair, y: Pair) -> Pair:
    """Sum of two pairs (high and low part)."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = quick(s, e + t)
    return quick(s, e + f)


def quick(s: np.ndarray, e: np.ndarray) -> Pair:
    h = s + e
    return h, e - (h - s)


def pair_of(x: np.ndarray) -> Pair:
    """High and low part of integers."""
    high = x.astype(np.float64)
    whole = np.array([int(h) for h in high.ravel()], object).reshape(x.shape) if x.dtype == object else high.astype(np.int64)
    return high, (x - whole).astype(np.float64)


class Outer:
    """The sum of the outer products of vectors with themselves: the upper triangle, in high and low parts."""

    def __init__(self, width: int):
        self.at = np.triu_indices(width)
        self.sum: Pair = (np.zeros(len(self.at[0])), np.zeros(len(self.at[0])))
        self.rows = max(1, (1 << 17) // max(1, len(self.at[0])))

    def take(self, high: np.ndarray, low: np.ndarray | None = None) -> None:
        """Adds rows, given as doubles or as pairs of them."""
        i, j = self.at
        for k in range(0, len(high), self.rows):
            h = high[k : k + self.rows]
            top, bottom = split(h)
            p, e = two_prod(h[:, i], h[:, j], (top[:, i], bottom[:, i]), (top[:, j], bottom[:, j]))
            if low is not None:
                rest = low[k : k + self.rows]
                e = e + (h[:, i] * rest[:, j] + rest[:, i] * h[:, j])
            while len(p) > 1:  # in pairs, down to one row
                half, odd = len(p) // 2, len(p) % 2
                s, f = two_sum(p[:half], p[half : 2 * half])
                f += e[:half] + e[half : 2 * half]
                p, e = (np.r_[s, p[-1:]], np.r_[f, e[-1:]]) if odd else (s, f)
            self.sum = add(self.sum, quick(p[0], e[0]))

    def full(self, divisor: int) -> np.ndarray:
        """The whole matrix, over the divisor."""
        total, width = (self.sum[0] + self.sum[1]) / float(divisor), self.at[0][-1] + 1 if len(self.at[0]) else 0
        out = np.zeros((width, width))
        out[self.at] = total
        return out + np.triu(out, 1).T


def outer_sum(rows: DataFrame, width: int, pairs, fan: int = 64) -> Outer:
    """Outer over all rows of a table; pairs(batch) gives a batch's rows as high and low parts (None: no low part).

    Each task hands on one row with its high and low parts. These meet in `fan` tasks and then in one, which hold one such row at a time.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Outer(width)
        for b in batches:
            total.take(*pairs(b))
        yield packed(total.sum)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Outer(width).sum
        for b in batches:
            for h, low in zip(b.column("high").to_pylist(), b.column("low").to_pylist(), strict=True):
                total = add(total, (np.frombuffer(h), np.frombuffer(low)))
        yield packed(total)

    schema, out = "high binary, low binary", Outer(width)
    (row,) = rows.mapInArrow(partial, schema).repartition(fan).mapInArrow(merge, schema).repartition(1).mapInArrow(merge, schema).collect()
    out.sum = (np.frombuffer(row.high), np.frombuffer(row.low))
    return out


def packed(p: Pair) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0].tobytes()], pa.binary()), pa.array([p[1].tobytes()], pa.binary())], ["high", "low"])
