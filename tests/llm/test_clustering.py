"""Elkan's bounds against plain rounds over all distances."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from peerlens.llm import clustering
from peerlens.llm.clustering import Assigner, Centroids, root, single


def plain(rows, k, rounds, scale, width, seed=3):
    x = [(i, [math.floor(scale * float(v)) for v in e]) for i, e in rows if e is not None and len(e) == width and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    points = [list(r[1]) for r in order[:k]]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    for n in range(rounds + 1):
        at = [min(range(len(points)), key=lambda c: (far(v, points[c]), c)) for _, v in x]
        if n < rounds:
            for c in range(len(points)):
                own = [v for (_, v), a in zip(x, at, strict=True) if a == c]
                points[c] = [sum(col) // len(own) for col in zip(*own, strict=True)] if own else points[c]
    d = [far(v, points[a]) for (_, v), a in zip(x, at, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return [(i, a, dd, sum(q for q, b in zip(d, at, strict=True) if b == a), sum(d), sha[a]) for (i, _), a, dd in zip(x, at, d, strict=True)]


def rows_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("k", "rounds", "scale", "spread"), [(4, 5, 1024, 1.0), (3, 6, 2, 1.0), (5, 0, 7, 3.0), (1, 2, 10, 1.0), (30, 3, 3, 1.0), (4, 3, 1 << 20, 1e11)])
def test_clusters_are_those_of_all_distances(spark, k, rounds, scale, spread):
    rng = np.random.default_rng(k)
    x = np.round(rng.standard_normal((24, 3)) * spread, 1)  # few values at a small scale: many ties
    rows = [(i, [float(v) for v in x[i % 20]]) for i in range(24)] + [(None, [0.0, 0.0, 0.0]), (7, [1.0, 1.0, 1.0]), (50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]), (54, [1.0] * 4)]
    df = spark.createDataFrame([(i, e, 1, 2.0) for i, e in rows], "vec_id bigint, embedding array<double>, cluster int, x double").repartition(3)
    got = rows_of(clustering.cluster_embeddings(spark, df, 3, scale, k, rounds))
    fits = lambda v: v if v < 1 << 63 else None
    assert got == sorted(((i, a, fits(d), fits(ci), fits(t), h) for i, a, d, ci, t, h in plain(rows, k, rounds, scale, 3)), key=str)


def test_bounds_skip_work_and_are_never_wrong(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 8)) * 20
    x = np.floor((centres[rng.integers(0, 6, 600)] + rng.standard_normal((600, 8))) * 50).astype(np.int64)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, x array<bigint>")
    done = clustering.elkan(spark, df, 8, k=6, rounds=8)
    assert done.work < done.full / 2
    a = Assigner(Centroids(x[:6].copy(), np.zeros(6)))
    own, upper, lower = np.zeros(600, np.int64), np.full(600, np.inf), np.zeros((600, 6))
    for step in range(5):
        own, upper, lower = a.assign(x, own, single(upper, True).astype(float), single(lower, False).astype(float))
        d = np.stack([clustering.squares(x, p) for p in a.c.points], axis=1)
        assert (own == d.argmin(axis=1)).all() and (upper >= np.sqrt(d[np.arange(600), own])).all() and (lower <= np.sqrt(d)).all()
        a = Assigner(a.c.then(a.c.points + rng.integers(-30, 30, (6, 8)) * (step + 1)))


def test_rounding_is_outwards():
    v = np.array([0, 1, 2, 3, (1 << 62) - 1, 10**17 + 3], np.int64)
    for up in (True, False):
        for s, r, f in zip(v.tolist(), root(v, up).tolist(), single(root(v, up), up).tolist(), strict=True):
            low, high = math.isqrt(s), math.isqrt(s) + (math.isqrt(s) ** 2 < s)
            assert (f >= r >= low if up else f <= r <= high) and (s == 0 or (r * r >= s if up else r * r <= s))


def test_without_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    assert clustering.cluster_embeddings(spark, df).count() == 0 == clustering.cluster_embeddings(spark, df.limit(0)).count()
