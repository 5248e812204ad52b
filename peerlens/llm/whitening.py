"""Whitening of embeddings: vectors of integers, their covariance with twice the digits of a double, its eigenvectors, and the projections on them.

The fit list holds each distinct vector once. With n of them and sums S, n * x - S is a vector of exact integers, n times the centred one; products of these are
summed in high and low parts by error-free transformations, and divided by n^3 at the very end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, workspace, written
from .eigen import symmetric_eigen
from .vectors import DECIMAL, Outer, as_decimals, column_sums, exact, integers, largest, long_or_none, matrix, outer_sum, pair_of

#: Eigenvalues up to so many times the largest, for each dimension, are none: what rounding leaves of directions that the vectors don't have.
NOISE = 1e-15


@dataclass(frozen=True)
class Whitener:
    """n vectors with sums S; eigenvalues by falling size and eigenvectors as columns; how far the whitened vectors' covariance is from the identity (None: no direction)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def rank(self) -> int:
        return int((self.values > max(NOISE * self.width * self.values[0], 0.0)).sum()) if self.width else 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        bound = self.n * largest(x) + max(map(abs, self.sums))
        return exact(x, bound) * self.n - np.array(self.sums, np.int64 if bound < 1 << 62 else object)

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """(x - S / n) on the first components, over the root of their eigenvalues."""
        return (self.centred(x) / self.n).astype(float) @ (self.vectors[:, :components] / np.sqrt(self.values[:components]))


def vectors(df: DataFrame, scale: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The key and `x`, the integers of the vector; null where there are none (see vectors.integers)."""
    return pick(df, **{key: "", column: ""}).select(F.col(key), integers(F.col(column), scale).alias("x"))


def fit(spark: SparkSession, x: DataFrame, components: int = 4) -> Whitener | None:
    """Fits to the distinct vectors in column x that have the commonest length (of equally common ones the greatest); None without any.

    The fit list is written once and read three times: sums, covariance, and the covariance of what is whitened. The driver gets sums and covariances alone.
    """
    distinct = written(spark, x.where("x is not null").select("x").distinct(), f"{workspace(spark)}/fit")
    length = distinct.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if length is None:
        return None
    width, n = length["width"], length["count"]
    rows = distinct.where(F.size("x") == width)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for b in batches:
            total = [s + t for s, t in zip(total, column_sums(matrix(b.column("x"), width)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), as_decimals(total)], ["i", "s"])

    sums = rows.mapInArrow(add_up, f"i int, s {DECIMAL}").groupBy("i").agg(F.sum("s").cast(DECIMAL).alias("s")).orderBy("i").collect()
    base = Whitener(n, tuple(int(r.s) for r in sums), np.zeros(0), np.zeros((0, 0)), 0.0)

    def centred(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | None]:
        high, low = pair_of(base.centred(matrix(b.column("x"), width)))
        return high, low if low.any() else None

    covariance = outer_sum(rows, width, centred).full(n**3)
    values, eigenvectors = symmetric_eigen(covariance)
    w = Whitener(n, base.sums, values, eigenvectors, float(np.trace(covariance)))
    kept = min(components, w.rank)
    if not kept:
        return w

    def projected(b: pa.RecordBatch) -> tuple[np.ndarray, None]:
        y = w.whitened(matrix(b.column("x"), width), kept)
        return np.c_[y, np.ones(len(y))], None  # the last column sums up the rows, for their mean

    second = outer_sum(rows, kept + 1, projected).full(n)
    mean = second[-1, :-1]
    error = float(np.abs(second[:-1, :-1] - np.outer(mean, mean) - np.eye(kept)).max())
    return Whitener(n, w.sums, values, eigenvectors, w.trace, error)


def whiten(x: DataFrame, w: Whitener | None, components: int = 4) -> DataFrame:
    """For every row whose vector has the fitted length: its other columns, `deviation` (sum of (n * x - S)^2, exact, null if it doesn't fit into a long) and
    `whitened`, an array with the first components; entries past the rank of the covariance are null, as there is nothing to divide by.
    """
    others = [c for c in x.columns if c != "x"]
    schema = ", ".join([*[f"`{c}` {x.schema[c].dataType.simpleString()}" for c in others], "deviation bigint, whitened array<double>"])
    if w is None:
        return x.limit(0).select(*others, F.lit(None).cast("bigint").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    kept, shown = min(components, w.rank), min(components, w.width)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = matrix(b.column("x"), w.width)
            c = w.centred(rows)
            c = exact(c, largest(c) ** 2 * w.width)
            y = np.c_[w.whitened(rows, kept) if kept else np.zeros((len(rows), 0)), np.full((len(rows), shown - kept), np.nan)]
            flat = pa.array(y.ravel(), pa.float64(), from_pandas=True)
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * shown, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in others], long_or_none((c * c).sum(axis=1)), out], [*others, "deviation", "whitened"])

    return x.where(F.size("x") == w.width).mapInArrow(project, schema)


def whiten_embeddings(spark: SparkSession, embeddings: DataFrame, scale: int = 256, components: int = 4) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1 on), n, deviation, whitened, explained (the component's share of the variance) and identity_error.

    Vectors that are null, empty, of another than the commonest length, or hold a null, NaN, infinite or 2^61-sized entry are dropped. Without variance (one distinct vector)
    whitened, explained and identity_error are null; components past the rank have a null `whitened`. Repeated rows and null vec_ids stay; further columns are ignored.
    """
    x = vectors(embeddings, scale)
    w = fit(spark, x, components)
    each = whiten(x, w, components).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    share = [float(v / w.trace) if w.trace > 0 else None for v in w.values[:components]] if w else []
    return each.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(w.n if w else None).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(s).cast("double") for s in share]).cast("array<double>"), F.col("i")).alias("explained"),
        F.lit(w.identity_error if w else None).cast("double").alias("identity_error"),
    )


__all__ = ["Outer", "Whitener", "fit", "vectors", "whiten", "whiten_embeddings"]
