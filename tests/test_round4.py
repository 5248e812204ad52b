"""What several results share is made once: rankings, draws; medians of gathered peers are those of rows for each peer."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from peerlens.config import DEFAULT
from peerlens.functions import md5
from peerlens.operators import blocks as B
from peerlens.operators import resample
from peerlens.operators import score as S
from peerlens.plans import QUERIES, serving_queries


def rankings(monkeypatch) -> list:
    """A list with an entry for every ranking that is planned from now on, each with the snapshots it ranks, and what a ranking's rows are counted by."""
    made, before = [], B.nearest

    def counted(f, *args, **kw):
        c = f.sparkSession.sparkContext.accumulator(0)
        made.append((sorted(r.as_of for r in f.select("as_of").distinct().collect()), c))

        def through(batches):
            for b in batches:
                c.add(len(b))
                yield b

        d = before(f, *args, **kw)
        return d.mapInArrow(through, d.schema)

    monkeypatch.setattr(B, "nearest", counted)
    return made


def test_a_ranking_runs_once(spark, monkeypatch):
    """Each firm's peers of each engine come out of the ranking once, whatever uses them."""
    sf = "/root/testdata/sf0.001"
    for name, engines in (("ablation_by_growth", 2), ("bootstrap_paired", 2)):
        made = rankings(monkeypatch)
        QUERIES[name](spark, sf).collect()
        monkeypatch.undo()
        (_, c), firms = made[0], QUERIES["feature_panel"](spark, sf).groupBy("as_of").count().collect()
        assert len(made) == 1 and c.value == sum(r["count"] * engines * min(5, r["count"] - 1) for r in firms), name


def test_bounds_of_reports_rank_dev_snapshots_once(spark, monkeypatch):
    sf, made = "/root/testdata/sf0.001", rankings(monkeypatch)
    serving_queries._SPECS.clear()
    serving_queries.serving_spec(spark, sf)
    (years, c), firms = made[0], QUERIES["feature_panel"](spark, sf).groupBy("as_of").count().collect()
    assert len(made) == 1 and years == list(DEFAULT.dev_years) and c.value == sum(min(10, r["count"] - 1) * r["count"] for r in firms if r.as_of in DEFAULT.dev_years)


def test_a_key_is_drawn_once(spark):
    """Cases with one key that lie apart come together before their weights are drawn."""
    d = spark.range(0, 600, 1, 6).select((F.col("id") % 10).cast("string").alias("key"))
    parts = [[r.key for r in rows] for rows in resample.together(d).rdd.glom().collect()]
    assert sum(len(set(p)) for p in parts) == 10 and all(p == sorted(p) for p in parts) and sum(map(len, parts)) == 600


def test_md5_of_words_that_all_messages_share():
    for n in (1, 27, 55, 56, 64, 130):
        m = np.frombuffer(random.Random(n).randbytes(40 * n), np.uint8).reshape(40, n).copy()
        m[:, : n // 2] = m[0, : n // 2]
        assert md5.leading_bits(m).tolist() == [int(hashlib.md5(bytes(r)).hexdigest()[:13], 16) for r in m]


def test_gathered_peers_give_the_medians_of_rows(spark):
    rnd = random.Random(3)
    r = spark.createDataFrame([(2000, f, q, rnd.choice([None, 0.0, rnd.uniform(-2, 2)]), 1.0, 1.0) for f in range(40) for q in ("a", "b")], "as_of int, firm bigint, ratio string, value double, num double, assets double")
    p = spark.createDataFrame([(e, 2000, f, g, i + 1, 0.5) for e in "xy" for f in range(40) for i, g in enumerate(rnd.sample([g for g in range(45) if g != f], rnd.randint(1, 5)))], "engine string, as_of int, firm bigint, peer bigint, rank int, sim double")
    want = S.peer_values(r, p, ("engine",)).groupBy("engine", "as_of", "firm", "ratio", "actual").agg(F.median("v").alias("m"), F.count("v").alias("n"))
    got = S.peer_lists(r, p, ("engine",)).select("engine", "as_of", "firm", "ratio", "actual", S.middle().alias("m"), F.size("v").cast("bigint").alias("n"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_weight_search_shuffles_no_pairs(spark):
    """Peers aren't copied for each group of targets, and of many peers only those are weighed that can reach a heap."""
    rng = np.random.default_rng(2)
    f = spark.createDataFrame([(1, i, "0001", *[float(x) for x in rng.normal(size=7)]) for i in range(300)], f"as_of int, firm bigint, code string, {', '.join(f'{c} double' for c in B.FEATURES)}")
    values = f.select("as_of", "firm", F.lit("p").alias("ratio"), F.col("g").alias("value"))
    d = B.grid_errors(f, values, spark.createDataFrame([(7.0,)], "penalty double"), ("scale", "growth"), np.array([[0.5, 0.5]]), 3, together=64, tile=64, tiles=2)
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString() and d.count() == 300
