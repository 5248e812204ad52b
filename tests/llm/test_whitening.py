"""Whitening against fractions and the eigen-solver against a library's."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from peerlens.llm import vectors, whitening
from peerlens.llm.eigen import symmetric_eigen


def matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 16, 33, 64):
        a = rng.standard_normal((n, n))
        q, _ = np.linalg.qr(a)
        yield a + a.T
        yield (q * np.r_[np.ones(n // 2), np.full(n - n // 2, 3.0)]) @ q.T
        yield (q * 10.0 ** -np.arange(n)) @ q.T
        yield np.outer(a[0], a[0])
        yield np.eye(n)
        yield np.zeros((n, n))
        yield np.diag(rng.integers(0, 3, n).astype(float))
        yield np.diag(np.abs(np.arange(n) - n // 2).astype(float)) + np.eye(n, k=1) + np.eye(n, k=-1)
        yield (a + a.T) * 1e-200


def test_eigen():
    for a in matrices():
        a = (a + a.T) / 2
        values, vec = symmetric_eigen(a)
        size = max(np.abs(a).max(), 1e-300)
        assert np.abs(a @ vec - vec * values).max() <= 1e-13 * size and np.abs(vec.T @ vec - np.eye(len(a))).max() < 1e-13
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size and (np.diff(values) <= 0).all()


def test_outer_keeps_what_doubles_lose():
    x = np.array([[2.0**53, 1.0], [3.0, 2.0**-40], [2.0**53, 1.0], [-7.0, 1 / 3]] * 5)
    o = vectors.Outer(2)
    o.rows = 3
    o.take(x)
    for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 1))):
        want = sum(Fraction(r[i]) * Fraction(r[j]) for r in x.tolist())
        assert abs(Fraction(float(o.sum[0][k])) + Fraction(float(o.sum[1][k])) - want) <= abs(want) * Fraction(1, 2**98)
    big = np.array([2**70 + 1, -(2**64) - 3, 5], object)
    high, low = vectors.pair_of(big)
    assert [int(Fraction(h) + Fraction(m)) for h, m in zip(high.tolist(), low.tolist(), strict=True)] == big.tolist()
    small = np.array([2**61 + 1, -5], np.int64)
    high, low = vectors.pair_of(small)
    assert [int(h) + int(m) for h, m in zip(high, low, strict=True)] == small.tolist()


def brute(rows, scale, components):
    x = {k: [math.floor(Fraction(v) * scale) for v in r] for k, r in rows.items()}
    fit = [list(t) for t in {tuple(v) for v in x.values()}]
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    c = [[Fraction(n * v[i] - s[i], n) for i in range(d)] for v in fit]
    cov = np.array([[float(sum(v[i] * v[j] for v in c) / n) for j in range(d)] for i in range(d)])
    values, vec = np.linalg.eigh(cov)
    values, vec = values[::-1], vec[:, ::-1]
    out = {k: (sum((n * v[i] - s[i]) ** 2 for i in range(d)), (np.array([float(Fraction(n * v[i] - s[i], n)) for i in range(d)]) @ vec / np.sqrt(values))[:components]) for k, v in x.items()}
    return n, out, values / values.sum()


@pytest.mark.parametrize(("scale", "size"), [(256, 1.0), (256, 1e9)])
def test_whitening_is_that_of_fractions(spark, scale, size):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 6)) * [5, 4, 3, 2, 1, 0.5] * size
    rows = {i: [float(np.float32(v)) for v in base[i % 50]] for i in range(60)}
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows.items()], "vec_id bigint, embedding array<float>, x int, Embedding int").repartition(5)
    got = whitening.whiten_embeddings(spark, df, scale).collect()
    n, want, share = brute(rows, scale, 4)
    assert len(got) == 240 and n == 50
    sign = {c: None for c in range(1, 5)}
    for r in got:
        dev, y = want[r.vec_id]
        assert r.n == n and r.deviation == (dev if dev < 1 << 63 else None)
        v = y[r.component - 1]
        sign[r.component] = sign[r.component] or (1 if r.whitened * v > 0 else -1)
        assert abs(r.whitened * sign[r.component] - v) < 1e-9 * max(1, abs(v))
        assert abs(r.explained - share[r.component - 1]) < 1e-12 and r.identity_error < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0, 5.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (10, [-0.0, 0.25]), (10, [-0.0, 0.25]), (11, [1e300, 1.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = whitening.whiten_embeddings(spark, df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((k, c) for k in (1, 2, 0, 10, 10) for c in (1, 2)) and {r.n for r in got} == {3}
    one = whitening.whiten_embeddings(spark, df.where("vec_id < 3")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, None, None)] * 4
    flat = whitening.whiten_embeddings(spark, spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [0.0, 0.0])], "vec_id bigint, embedding array<double>")).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and all(r.identity_error < 1e-12 for r in flat)
    assert whitening.whiten_embeddings(spark, df.limit(0)).count() == 0 == whitening.whiten_embeddings(spark, df.where("vec_id in (4, 5)")).count()
