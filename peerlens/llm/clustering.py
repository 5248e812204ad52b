"""Clustering by centroids with Elkan's bounds: exact integer assignments, most distances never calculated.

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to each centroid. When centroids move, the bounds give way
by as much. A centroid is left out only if its lower bound, or half of its distance from the vector's own one, is strictly above the upper bound; all bounds are
rounded outwards, so a centroid that ties is never left out. Whatever is compared in the end are squared distances of integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, workspace, written
from .vectors import DECIMAL, as_decimals, column_sums, exact, largest, long_or_none, matrix
from .whitening import vectors

#: What a square root of an integer, rounded to a double, can be off by, several times over.
SLACK = 2.0**-50
#: In place of a dimension: how many vectors a cluster has, the sum of their squared distances, and how many distances were calculated.
COUNT, INERTIA, WORK = -1, -2, -3


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows from a point (or from a row each)."""
    d = x - c
    d = exact(d, largest(d) ** 2 * max(1, x.shape[1]))
    return (d * d).sum(axis=1)


def root(squared: np.ndarray, up: bool) -> np.ndarray:
    """Square roots as doubles that are surely not below (up) or not above the true ones."""
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK if up else 1 - SLACK)


def single(x: np.ndarray, up: bool) -> np.ndarray:
    """In single precision, rounded outwards."""
    y = x.astype(np.float32)
    off = y < x if up else y > x
    return np.where(off, np.nextafter(y, np.float32(np.inf if up else -np.inf)), y)


@dataclass(frozen=True)
class Centroids:
    """Points as rows of integers, and how far each has moved since the bounds were made (never too little)."""

    points: np.ndarray
    moved: np.ndarray

    @property
    def k(self) -> int:
        return len(self.points)

    def halves(self) -> np.ndarray:
        """Half the distances between centroids, never too much; infinite to themselves."""
        h = np.stack([root(squares(self.points, p), up=False) for p in self.points]) / 2
        np.fill_diagonal(h, np.inf)
        return h

    def then(self, points: np.ndarray) -> Centroids:
        return Centroids(points, root(squares(self.points, points), up=True))

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(str(int(v)) for v in p).encode()).hexdigest() for p in self.points]


class Assigner:
    """Brings a batch's assignments and bounds up to date."""

    def __init__(self, c: Centroids):
        self.c, self.halves = c, c.halves()
        self.nearest = self.halves.min(axis=1)
        self.work = 0

    def distances(self, x: np.ndarray, rows: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        self.work += len(rows)
        return squares(x[rows], self.c.points[at])

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper bound, lower bounds) of the rows of x."""
        own = own.copy()
        upper = np.nextafter(upper + self.c.moved[own], np.inf)
        lower = np.maximum(np.nextafter(lower - self.c.moved, -np.inf), 0.0)
        open_ = np.flatnonzero(upper >= self.nearest[own])
        if not len(open_):
            return own, upper, lower
        best = self.distances(x, open_, own[open_])
        mine, up, low = own[open_], root(best, up=True), lower[open_]
        low[np.arange(len(open_)), mine] = root(best, up=False)
        for c in range(self.c.k):
            near = np.flatnonzero((mine != c) & (low[:, c] <= up) & (self.halves[mine, c] <= up))
            if not len(near):
                continue
            d = self.distances(x, open_[near], c)
            low[near, c] = root(d, up=False)
            closer = (d < best[near]) | ((d == best[near]) & (c < mine[near]))
            won = near[closer.astype(bool)]
            best = best.astype(object) if d.dtype == object else best
            best[won], mine[won] = d[closer.astype(bool)], c
            up[won] = root(best[won], up=True)
        own[open_], upper[open_], lower[open_] = mine, up, low
        return own, upper, lower


def step(state: DataFrame, c: Centroids, width: int, final: bool) -> DataFrame:
    """The state after one assignment; each task's last row has, in place of a vector, its sums for each cluster and dimension (see COUNT and its neighbours)."""
    key = state.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Assigner(c)
        sums, counts, inertia = [[0] * width for _ in range(c.k)], [0] * c.k, [0] * c.k
        names = ["vec_id", "x", "cluster", "upper", "lower", "distance", "sums"]
        kinds = [None, pa.list_(pa.int64()), pa.int32(), pa.float32(), pa.list_(pa.float32()), pa.int64(), pa.list_(pa.struct([("cluster", pa.int32()), ("i", pa.int32()), ("s", pa.decimal128(38, 0))]))]
        kind = None
        for b in batches:
            kind, n = b.schema.field("vec_id").type, len(b)
            x = matrix(b.column("x"), width)
            own, upper, lower = a.assign(x, b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), b.column("upper").to_numpy(zero_copy_only=False).astype(np.float64), matrix(b.column("lower"), c.k).astype(np.float64))
            distance = squares(x, c.points[own]) if final else None
            for j in np.unique(own).tolist():
                rows = own == j
                sums[j] = [s + t for s, t in zip(sums[j], column_sums(x[rows]), strict=True)]
                counts[j] += int(rows.sum())
                inertia[j] += sum(distance[rows].tolist()) if final else 0
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * c.k, pa.int32()), pa.array(single(lower, up=False).ravel()))
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id"), b.column("x"), pa.array(own, pa.int32()), pa.array(single(upper, up=True)), bounds, long_or_none(distance) if final else pa.nulls(n, pa.int64()), pa.nulls(n, kinds[6]),
            ], names)
        if kind is None:
            return
        flat = [(j, i, s) for j in range(c.k) for i, s in enumerate(sums[j])] + [(j, i, v[j]) for i, v in ((COUNT, counts), (INERTIA, inertia)) for j in range(c.k)] + [(0, WORK, a.work)]
        totals = pa.StructArray.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.int32()), as_decimals([f[2] for f in flat])], ["cluster", "i", "s"])
        last = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), totals)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *[pa.nulls(1, k) for k in kinds[1:6]], last], names)

    return state.mapInArrow(run, f"vec_id {key}, x array<bigint>, cluster int, upper float, lower array<float>, distance bigint, sums array<struct<cluster:int,i:int,s:{DECIMAL}>>")


def totals(table: DataFrame) -> dict[tuple[int, int], int]:
    """What the tasks have summed up, over all of them: (dimensions + 3) numbers for each cluster."""
    each = table.where("sums is not null").select(F.explode("sums").alias("t")).select("t.*")
    return {(r.cluster, r.i): int(r.s) for r in each.groupBy("cluster", "i").agg(F.sum("s").cast(DECIMAL).alias("s")).collect()}


def mean_points(before: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Componentwise floor(sum / count); a point without vectors stays."""
    rows = [[sums[j, i] // n for i in range(before.shape[1])] if (n := sums.get((j, COUNT), 0)) else [int(v) for v in before[j]] for j in range(len(before))]
    return np.array(rows, before.dtype)


@dataclass(frozen=True)
class Clustering:
    """`rows` (vec_id, x, cluster, distance), the final points, and what was calculated: distances, of `full` that there are."""

    rows: DataFrame
    centroids: Centroids
    sums: dict[tuple[int, int], int]
    work: int
    full: int


def elkan(spark: SparkSession, x: DataFrame, width: int, k: int = 8, rounds: int = 10, seed: int = 3) -> Clustering | None:
    """Clusters the vectors in column x that have `width` entries; None without any.

    The first points are the k vectors (or as many as there are) with the smallest SHA-256 of `seed:vec_id`, ties by their entries, null ids last. Each round writes
    the vectors with their bounds as a table, from which the next one goes on, and deletes the one before. Once no point moves, further rounds would change nothing and
    are left out. The driver holds k points and their sums.
    """
    at, kept = workspace(spark), x.where(F.size("x") == width)
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return None
    points = np.array([r.x for r in first], np.int64)
    c, full, work = Centroids(points, np.zeros(len(points))), 0, 0
    state = kept.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(float("inf")).cast("float").alias("upper"), F.array_repeat(F.lit(0.0).cast("float"), len(first)).alias("lower"))
    for r in range(rounds + 1):
        final = r == rounds
        table = written(spark, step(state, c, width, final), f"{at}/round{r}")
        sums = totals(table)
        if r:
            forget(spark, f"{at}/round{r - 1}")
        work, full = work + sums[0, WORK], full + c.k * sum(sums[j, COUNT] for j in range(c.k))
        state = table.where("x is not null").select("vec_id", "x", "cluster", "upper", "lower")
        after = c.then(mean_points(c.points, sums))
        if not final and not after.moved.any():  # the last assignment differs from this one by its distances alone
            table = written(spark, step(state, after, width, final=True), f"{at}/round{rounds}")
            forget(spark, f"{at}/round{r}")
            sums = totals(table)
            work = work + sums[0, WORK]
            break
        c = c if final else after
    return Clustering(table.where("x is not null").select("vec_id", "x", "cluster", "distance"), c, sums, work, full)


def cluster_embeddings(spark: SparkSession, embeddings: DataFrame, width: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """For each vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Vectors that are null, of another width, or hold a null, NaN, infinite or 2^61-sized entry are dropped. Equal vectors are in one cluster; repeated rows and null vec_ids stay.
    With fewer vectors than k there are as many clusters as vectors. Sums that don't fit into a long are null. Further columns are ignored.
    """
    done = elkan(spark, vectors(embeddings, scale), width, k, rounds, seed)
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if done is None:
        return vectors(embeddings, scale).limit(0).select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    fits = lambda v: v if v < 1 << 63 else None
    each = [done.sums[j, INERTIA] for j in range(done.centroids.k)]
    facts = spark.createDataFrame([(j, fits(v), fits(sum(each)), h) for j, (v, h) in enumerate(zip(each, done.centroids.digests(), strict=True))], schema)
    return done.rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
