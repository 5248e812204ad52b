"""Ranking by blocks against pairs, the grid scorer against a plain loop, and bootstrap replicates against drawn-out samples."""

from __future__ import annotations

import hashlib
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.config import DEFAULT
from peerlens.functions import md5
from peerlens.operators import axes as A
from peerlens.operators import blocks as B
from peerlens.operators import resample
from peerlens.operators import score as S
from peerlens.operators import text as X

SCHEMA = "as_of int, firm bigint, code string, ln_rev double, ln_ast double, ln_cap double, g double, s_n double, s_top double, s_hhi double"


@pytest.fixture(scope="module")
def firms(spark):
    rng = np.random.default_rng(3)
    rows = [(y, i, ["0101", "0102", "0201", ""][i % 4], *[None if rng.random() < 0.1 else float(round(rng.random(), 2)) for _ in range(7)]) for y in (1, 2) for i in range(23) if (i + y) % 9]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def vectors(spark):
    return X.tfidf(spark.createDataFrame([(i, f"abc{'xyz' * (i % 4)} {'qrs' * (i % 3)}abd") for i in range(0, 23, 2)], "doc bigint, text string"), 3, 50)


@pytest.mark.parametrize("size", [5, 256])
def test_ranks_are_those_of_all_pairs(spark, firms, vectors, size):
    w = {"industry": 0.3, "scale": 0.2, "mktcap": 0.1, "text": 0.2, "growth": 0.1, "segment": 0.1}
    rows = lambda d: sorted((r.as_of, r.firm, r["rank"], r.peer, round(r.sim, 8)) for r in d.collect())
    plain = rows(A.top_k(A.scored(firms, w, X.cosines(vectors)), 4))
    assert rows(B.ranked(firms, w, 4, vectors, size)) == plain
    both = B.engines(firms, {"w": (w, 4), "base": (None, 3)}, vectors, size=size)
    assert rows(both.where("engine = 'w'")) == plain
    base = sorted((r.as_of, r.firm, r["rank"], r.peer) for r in B.baseline(firms, 3, size=size).collect())
    assert sorted((r.as_of, r.firm, r["rank"], r.peer) for r in both.where("engine = 'base'").collect()) == base
    best = {(r.as_of, r.firm): pytest.approx((r.best, r["mean"]), abs=1e-9) for r in B.axis_profile(firms, "scale", size=size).collect()}
    want = A.pairs(firms).groupBy("as_of", "firm").agg(F.max(F.round(A.AXES["scale"](), 6)).alias("b"), F.avg(F.round(A.AXES["scale"](), 6)).alias("m")).collect()
    assert {(r.as_of, r.firm): (r.b, r.m) for r in want} == best


def test_heap_with_negative_similarities_and_no_peer():
    sim = np.array([[[5, -7, -7, B.Heap.ABSENT], [0, 0, 0, B.Heap.ABSENT]]])
    ratio = np.array([[1.0, 2.0, np.nan, 9.0]])
    h = B.Heap.empty(1, 2, 1)
    for j in (0, 2):
        h = h.take(sim[:, :, j : j + 2], np.array([10, 20, 30, 40])[j : j + 2], ratio[:, j : j + 2], 3)
    assert h.peer.tolist() == [[[10, 20, 30], [10, 20, 30]]] and h.sim.tolist() == [[[5, -7, -7], [0, 0, 0]]]
    assert h.errors(np.array([[3.0]]), 9.0, 2).tolist() == [[[0.5], [0.5]]] and h.errors(np.array([[0.0]]), 9.0, 2).tolist() != [[[0.5], [0.5]]]
    alone = B.Heap.empty(1, 1, 1).take(np.array([[[B.Heap.ABSENT]]]), np.array([7]), np.array([[1.0]]), 2)
    assert alone.errors(np.array([[3.0]]), 9.0, 1).tolist() == [[[9.0]]]


@pytest.mark.parametrize("sizes", [{}, {"together": 5, "tile": 2, "tiles": 1}, {"together": 3, "tile": 2, "tiles": 5}])
def test_grid_against_one_ranking_for_each_weighting(spark, firms, vectors, sizes):
    """All peers at once, ten tiles that each hand on heaps, and heaps over five tiles each."""
    rng, names = np.random.default_rng(5), ("industry", "scale", "text")
    values = spark.createDataFrame([(y, i, r, None if rng.random() < 0.2 else float(rng.random())) for y in (1, 2) for i in range(23) for r in ("p", "q")], "as_of int, firm bigint, ratio string, value double")
    pen, grid = spark.createDataFrame([(7.0,)], "penalty double"), np.array([[1.0, 0.0, 0.0], [0.2, 0.5, 0.3], [0.0, 0.0, 1.0], [3.0, 4.0, 2.0]])
    got = {(r.g, r.as_of, r.firm, r.ratio): r.ape for r in B.grid_errors(firms, values, pen, names, grid, 4, vectors, **sizes).collect()}
    inside = values.join(firms.select("as_of", "firm"), ["as_of", "firm"])
    for g, w in enumerate(grid.tolist()):
        p = B.ranked(firms, dict(zip(names, w, strict=True)), 4, vectors)  # normalises weights, which leaves the order
        want = {(g, r.as_of, r.firm, r.ratio): r.ape for r in S.peer_cases(inside, p, pen).collect()}
        assert {k: v for k, v in got.items() if k[0] == g} == pytest.approx(want)


def hashed(b, key):
    return int(hashlib.md5(f"{b}|{key}".encode()).hexdigest()[:13], 16)


def drawn_out(rows, number):
    """Medians of the samples themselves, every case as often as it is drawn."""
    bounds, out = resample.poisson_bounds(), {}
    for b in range(-1, number):
        times = [1 if b < 0 else sum(hashed(b, k) >= z for z in bounds) for k, _, _ in rows]
        xs, ys = ([r[c] for r, n in zip(rows, times, strict=True) for _ in range(n)] for c in (1, 2))
        out[b] = pytest.approx(statistics.median(xs) - statistics.median(ys)) if xs else None
    return out


@pytest.mark.parametrize("most", [0, 3, 200_000])
def test_replicates_against_drawn_out_samples(spark, most):
    rng = np.random.default_rng(2)
    for rows in (
        [(f"k{i % 7}", float(i * 37 % 11), float(i * 17 % 13)) for i in range(25)],
        [(f"{i}|é{i % 5}", float(rng.standard_normal()), float(rng.integers(0, 2))) for i in range(160)],
        [("a", 1.0, 5.0)], [(f"k{i}", 2.0, -1.5) for i in range(9)],
    ):
        d = spark.createDataFrame(rows, "key string, x double, y double").repartition(3)
        assert {r.b: r.d for r in resample.replicates(d, 120, most).collect()} == drawn_out(rows, 120)
    assert {r.d for r in resample.replicates(d.limit(0), 5, most).collect()} == {None}


def test_intervals(spark):
    bounds = resample.poisson_bounds()
    assert len(bounds) > 15 and bounds[0] == round(np.exp(-1) * 2**52) and bounds == sorted(set(bounds))
    one = resample.interval(spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 9.0), ("c", 1.5, 7.0)], "key string, x double, y double"), 200).first()
    assert one.n == 3 and one.difference == -5.5 and one.better and DEFAULT.replicates == 2000


@pytest.mark.parametrize("length", [0, 1, 7, 54, 55, 56, 63, 64, 65, 119, 120, 200])
def test_digests_of_many_messages(length):
    m = np.random.default_rng(length).integers(0, 256, (40, length), dtype=np.uint8)
    assert md5.leading_bits(m).tolist() == [int(hashlib.md5(bytes(r)).hexdigest()[:13], 16) for r in m]


def test_random_peers_are_a_shuffle_of_the_others(spark):
    rows = [(1, i) for i in range(9)] + [(2, i * 7) for i in range(3)] + [(3, 5)]
    f = spark.createDataFrame(rows, "as_of int, firm bigint").repartition(4)
    assert sorted((r.as_of, r.pos, r.n) for r in A.numbered(f).collect()) == [(1, i, 9) for i in range(9)] + [(2, i, 3) for i in range(3)] + [(3, 0, 1)]
    got = {}
    for r in A.random_peers(f, 20, 7).orderBy("rank").collect():
        got.setdefault((r.as_of, r.firm), []).append(r.peer)
    assert {k: sorted(v) for k, v in got.items()} == {(y, i): sorted(j for z, j in rows if z == y and j != i) for y, i in rows if y < 3}
    many = spark.createDataFrame([(1, i) for i in range(60)], "as_of int, firm bigint")
    n = np.bincount([r.peer for s in range(12) for r in A.random_peers(many, 5, s).collect()], minlength=60)
    assert n.sum() == 12 * 300 and n.min() > 25 and n.max() < 105  # 60 each on average
    assert "CartesianProduct" not in (plan := A.random_peers(many, 5, 1)._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_blocks_are_written_once_and_nothing_is_shuffled_by_pairs(spark, firms, vectors):
    """Ranks come back from the task that has read all blocks: no window over what blocks found, and ties in the last place go to the smaller peer."""
    d = B.ranked(firms, {"industry": 0.5, "text": 0.5}, 4, vectors, 3)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    same = spark.createDataFrame([(1, i, "0101", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(40)], SCHEMA)
    for w in ({"scale": 1.0}, None):
        got = {r.firm: [] for r in same.collect()}
        for r in B.engines(same, {"": (w, 3)}, size=7).orderBy("rank").collect():
            got[r.firm].append(r.peer)
        assert got == {i: [j for j in range(4) if j != i][:3] for i in range(40)}


def test_large_features_and_missing_ones_rank_as_pairs_do(spark):
    rng = np.random.default_rng(8)
    some = lambda s: None if rng.random() < 0.2 else float(rng.normal() * s)
    f = spark.createDataFrame([(1, i, ["0101", "0102", "0201", ""][int(rng.integers(4))], some(1), some(1), some(2), some(10.0 ** int(rng.integers(0, 7))), some(1), some(1), some(1)) for i in range(90)], SCHEMA)
    w = {"industry": 0.2, "scale": 0.2, "growth": 0.6}
    rows = lambda d: sorted((r.as_of, r.firm, r["rank"], r.peer, round(r.sim, 8)) for r in d.collect())
    assert rows(B.ranked(f, w, 4, None, 16)) == rows(A.top_k(A.scored(f, w), 4))


def test_cosines_are_told_where_they_weigh_nothing(spark, firms, vectors):
    w = {"scale": 1.0, "text": 0.0}
    rows = lambda d: sorted((r.as_of, r.firm, r["rank"], r.peer, round(r.text, 8)) for r in d.collect())
    assert rows(B.ranked(firms, w, 4, vectors, 9)) == rows(A.top_k(A.scored(firms, w, X.cosines(vectors)), 4))
