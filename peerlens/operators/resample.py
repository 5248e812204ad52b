"""Bootstrap intervals of a difference of medians, from weighted counts that merge.

A replicate weights every case by a Poisson draw made from a hash of the replicate and the case's key, so any task can draw for the cases it has. A task answers with a
histogram of its cases' weights for each replicate; merged histograms say in which bin a replicate's median lies and how much weight is below it. What is left of the
values, between the lowest and the highest such bin of all replicates, is refined the same way until it is little, and sorted. No task sees all cases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.functions.md5 import leading_bits
from peerlens.sources.snapshots import stored

#: Bits of a draw; 13 hexadecimal digits of an MD5.
BITS = 52
#: Values that may be sorted in the end, and replicates that a task sorts them for.
SORTED, TOGETHER = 200_000, 100
#: Shares of the cases at which the first histogram's bins end: close together around the median.
SHARES = sorted({0.5 + s * 0.5**i for i in range(2, 16) for s in (-1, 1)} | {0.5})
#: Draws that are held at a time.
CHUNK = 1 << 19


def poisson_bounds(mean: float = 1.0) -> list[int]:
    """A draw's count is how many of these it reaches: the distribution's steps, as far as the draw's bits tell them apart."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while (bound := round((total + term) * (1 << BITS))) < 1 << BITS:
        out.append(bound)
        total, k = total + term, k + 1
        term *= mean / k
    return out


def draws(replicates: range, keys: list[bytes]) -> np.ndarray:
    """How often each replicate takes each key (rows: replicates); replicate -1 takes every key once, and so is the sample itself."""
    bounds, out = np.array(poisson_bounds(), np.int64), np.ones((len(replicates), len(keys)), np.int64)
    sizes = np.array([len(k) for k in keys], np.int64)
    heads = [f"{b}|".encode() if b >= 0 else b"" for b in replicates]
    widths = np.array([len(h) for h in heads], np.int64)
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        tails = np.frombuffer(b"".join(keys[i] for i in of), np.uint8).reshape(len(of), size)
        for width in np.unique(widths[widths > 0]).tolist():
            rows = np.flatnonzero(widths == width)
            starts = np.frombuffer(b"".join(heads[i] for i in rows), np.uint8).reshape(len(rows), width)
            message = np.empty((len(rows), len(of), width + size), np.uint8)
            message[:, :, :width], message[:, :, width:] = starts[:, None, :], tails[None, :, :]
            drawn = leading_bits(message.reshape(-1, width + size), BITS)
            out[np.ix_(rows, of)] = np.searchsorted(bounds, drawn, side="right").reshape(len(rows), len(of))
    return out


def each_draw(keys: list[str], number: int, of: np.ndarray) -> Iterator[tuple[range, np.ndarray]]:
    """Some replicates and their weights of all cases, again and again until all `number` replicates and the sample itself (-1) are through; of: each case's key."""
    raw, step = [k.encode() for k in keys], max(1, CHUNK // max(1, len(of), len(keys)))
    for low in range(-1, number, step):
        some = range(low, min(low + step, number))
        yield some, draws(some, raw)[:, of]


def together(cases: DataFrame) -> DataFrame:
    """The cases of a key next to each other in one task."""
    return cases.repartition(4 * cases.sparkSession.sparkContext.defaultParallelism, "key").sortWithinPartitions("key")


def histogram(cases: DataFrame, number: int, inside: dict[str, tuple[float, float]], edges: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each side (x, y): the weight that each replicate has in each bin, and each bin's number of cases with their smallest and largest value.

    Only values inside the side's interval count; edges cut it into bins. The cases of a key come together, so that a key's weights are drawn once. Tasks' histograms are added up
    block by block of replicates, one at a time.
    """
    blocks = -(-(number + 1) // TOGETHER)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros((number + 1, len(edges[s]) + 1), np.int64) for s in edges}
        facts = {s: np.array([[0.0, math.inf, -math.inf]] * (len(edges[s]) + 1)) for s in edges}
        for b in batches:
            keys, of = np.unique(b.column("key").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            at = {}
            for s in edges:
                v = b.column(s).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero((v >= inside[s][0]) & (v < inside[s][1]))
                bins = np.searchsorted(edges[s], v[rows], side="right")
                order = np.argsort(bins, kind="stable")
                rows, bins = rows[order], bins[order]
                first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]]) if len(bins) else np.zeros(0, np.int64)
                at[s] = rows, bins[first], first
                for i, j, k in zip(bins[first], first, np.r_[first[1:], len(rows)], strict=True):
                    own = v[rows[j:k]]
                    facts[s][i] = facts[s][i][0] + len(own), min(facts[s][i][1], own.min()), max(facts[s][i][2], own.max())
            for some, w in each_draw(keys.tolist(), number, of):
                for s, (rows, bins, first) in at.items():
                    if len(rows):
                        sums[s][some.start + 1 : some.stop + 1, bins] += np.add.reduceat(w[:, rows], first, axis=1)
        for s in edges:
            for k in range(blocks):
                yield packed(s, k, sums[s][k * TOGETHER : (k + 1) * TOGETHER])
            yield packed(s, FACTS, facts[s])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for side, k, raw in zip(*[batch.column(c).to_pylist() for c in ("side", "block", "payload")], strict=True):
                total[side, k] = _added(total.get((side, k)), _unpacked(k, raw))
        for (side, k), a in total.items():
            yield packed(side, k, a)

    schema = "side string, block int, payload binary"
    got = {(r.side, r.block): _unpacked(r.block, r.payload) for r in together(cases).mapInArrow(partial, schema).repartition("side", "block").mapInArrow(merge, schema).collect()}
    if not got:  # no cases, and so no tasks
        return {s: (np.zeros((number + 1, len(e) + 1), np.int64), np.array([[0.0, math.inf, -math.inf]] * (len(e) + 1))) for s, e in edges.items()}
    return {s: (np.concatenate([got[s, k].reshape(-1, len(edges[s]) + 1) for k in range(blocks)]), got[s, FACTS]) for s in edges}


#: Block number of the bins' facts.
FACTS = -1


def packed(side: str, block: int, a: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([side]), pa.array([block], pa.int32()), pa.array([a.tobytes()], pa.binary())], ["side", "block", "payload"])


def _unpacked(block: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, 3) if block == FACTS else np.frombuffer(raw, np.int64)


def _added(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return b.copy()
    return np.c_[a[:, 0] + b[:, 0], np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 2], b[:, 2])] if a.ndim == 2 else a + b


@dataclass
class Side:
    """Where the replicates' medians of x or of y can be: inside the interval, below which each replicate has so much weight; `total` is all its weight."""

    low: float = -math.inf
    high: float = math.inf
    cases: int = 0
    below: np.ndarray | None = None
    total: np.ndarray | None = None
    medians: np.ndarray | None = None  # once they are known

    def narrow(self, counts: np.ndarray, facts: np.ndarray, edges: np.ndarray) -> None:
        """Takes the bins that hold a replicate's middle ranks; they are the new interval, or the medians if each has one value alone."""
        if self.total is None:
            self.below, self.total = np.zeros(len(counts), np.int64), counts.sum(axis=1)
        upto, live = self.below[:, None] + np.cumsum(counts, axis=1), self.total > 0
        bins = [(upto <= rank[:, None]).sum(axis=1)[live] for rank in ((self.total - 1) // 2, self.total // 2)]
        used = np.unique(np.concatenate(bins))
        if not len(used) or (facts[used, 1] == facts[used, 2]).all():
            self.medians = np.full(len(counts), np.nan)
            self.medians[live] = (facts[bins[0], 1] + facts[bins[1], 1]) / 2 if len(used) else 0.0
            return
        first, last = int(used[0]), int(used[-1])
        self.below = upto[:, first - 1] if first else self.below
        self.low, self.high = float(edges[first - 1]) if first else self.low, float(edges[last]) if last < len(edges) else self.high
        self.cases = int(facts[first : last + 1, 0].sum())


def kept(cases: DataFrame) -> DataFrame:
    """The cases as a table in the shared folder, so that what they come from is made once."""
    return stored(cases.select(F.col("key").cast("string").alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))


def replicates(cases: DataFrame, number: int, most: int = SORTED) -> DataFrame:
    """b, d of each replicate; see middles()."""
    return middles(kept(cases), number, most)


def middles(rows: DataFrame, number: int, most: int = SORTED) -> DataFrame:
    """b, d (median of x less median of y) of each replicate, and of the sample itself (b = -1); d is null where a replicate draws nothing. rows: key, x, y from kept(), none of them null or NaN.

    Cases with one key are drawn together. The driver gets histograms: so many numbers as there are replicates and bins.
    """
    spark: SparkSession = rows.sparkSession
    sides, shares, n = {"x": Side(), "y": Side()}, SHARES, rows.count()
    for s in sides.values():
        s.cases = n
    while (open_ := {k: s for k, s in sides.items() if s.medians is None}) and (any(s.total is None for s in open_.values()) or max(s.cases for s in open_.values()) > most):
        within = lambda k, s: (F.col(k) >= F.lit(s.low)) & (F.col(k) < F.lit(s.high))
        own = rows.where(reduce(lambda a, b: a | b, [within(k, s) for k, s in open_.items()]))
        q = own.agg(*[F.percentile_approx(F.when(within(k, s), F.col(k)), F.array(*map(F.lit, shares)), F.lit(20_000)).alias(k) for k, s in open_.items()]).first()
        edges = {k: np.unique([e for v in q[k] or [] for e in (v, np.nextafter(v, math.inf))]) for k in open_}
        for k, (counts, facts) in histogram(own, number, {k: (s.low, s.high) for k, s in open_.items()}, edges).items():
            sides[k].narrow(counts, facts, edges[k])
        shares = [i / 64 for i in range(1, 64)]
    blocks = -(-(number + 1) // TOGETHER)
    inside = reduce(lambda a, b: a | b, [(F.col(k) >= F.lit(s.low)) & (F.col(k) < F.lit(s.high)) if s.medians is None else F.lit(False) for k, s in sides.items()])
    left = rows.where(inside).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each = spark.range(blocks).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.col("id").cast("int").alias("block"))  # no block is without a row
    return left.unionByName(each).groupBy("block").applyInArrow(lambda key, t: _middles(key[0].as_py(), t, number, sides), "b int, d double")


def _middles(block: int, t: pa.Table, number: int, sides: dict[str, Side]) -> pa.Table:
    """The differences of one block's replicates, from the values that are left (at most SORTED on either side)."""
    some = range(block * TOGETHER - 1, min((block + 1) * TOGETHER - 1, number))
    t = t.filter(pc.is_valid(t.column("key")))
    keys, of = np.unique(t.column("key").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    raw, medians = [k.encode() for k in keys.tolist()], {}
    columns = {}
    for k, s in sides.items():
        if s.medians is None:
            v = t.column(k).to_numpy(zero_copy_only=False)
            at = np.flatnonzero((v >= s.low) & (v < s.high))
            columns[k] = at[np.argsort(v[at], kind="stable")], v
        medians[k] = np.full(len(some), np.nan) if s.medians is None else s.medians[some.start + 1 : some.stop + 1]
    step = max(1, CHUNK // max(1, len(of)))
    for low in range(some.start, some.stop, step) if columns else ():
        part = range(low, min(low + step, some.stop))
        w = draws(part, raw)
        for k, (order, v) in columns.items():
            s = sides[k]
            upto = np.cumsum(w[:, of[order]], axis=1)
            for i, b in enumerate(part):
                total = int(s.total[b + 1])
                if total:
                    j = np.searchsorted(upto[i] + int(s.below[b + 1]), [(total - 1) // 2, total // 2], side="right")
                    medians[k][b - some.start] = v[order[j]].mean()
    return pa.table({"b": pa.array(list(some), pa.int32()), "d": pa.array(medians["x"] - medians["y"], pa.float64(), from_pandas=True)})


def interval(cases: DataFrame, number: int) -> DataFrame:
    """replicates, n, difference (of the cases themselves), low, mid, high (2.5, 50, 97.5 %), better: whether x is smaller beyond doubt."""
    rows = kept(cases)
    d = middles(rows, number)
    drawn = F.when(F.col("b") >= 0, F.col("d"))
    q = d.agg(F.count(drawn).alias("replicates"), F.max(F.when(F.col("b") < 0, F.col("d"))).alias("difference"), *[F.percentile(drawn, F.lit(p)).alias(c) for p, c in ((0.025, "low"), (0.5, "mid"), (0.975, "high"))])
    q = q.crossJoin(rows.agg(F.count("*").alias("n")))  # one row each
    return q.withColumn("better", F.coalesce(F.col("high") < 0, F.lit(False)))


def interval_sql(cases: str, number: int) -> str:
    """The same for DuckDB, from the name of a table expression with key, x, y."""
    count = " + ".join(f"(u >= {b})::INT" for b in poisson_bounds())
    return f"""dr AS (SELECT b, x, y, {count} AS m FROM (SELECT b, x, y, ('0x' || substr(md5(concat_ws('|', b::VARCHAR, key)), 1, {BITS // 4}))::BIGINT AS u
      FROM {cases} CROSS JOIN (SELECT unnest(range(0, {number})) AS b))),
    ex AS (SELECT b, x, y, unnest(range(0, m)) AS i FROM dr WHERE m > 0), ds AS (SELECT b, median(x) - median(y) AS d FROM ex GROUP BY b),
    own AS (SELECT count(*) AS n, median(x) - median(y) AS difference FROM {cases})
    SELECT count(d) AS replicates, any_value(n) AS n, round(any_value(difference), 6) AS difference, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.5), 6) AS mid,
      round(quantile_cont(d, 0.975), 6) AS high, quantile_cont(d, 0.975) < 0 AS better FROM ds CROSS JOIN own"""
