"""Single-firm reports, kept contexts, sealed parameters and the holdout they decide."""

from __future__ import annotations

import json
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from peerlens.config import DEFAULT
from peerlens.operators import blocks as B
from peerlens.operators import score as S
from peerlens.operators import single
from peerlens.plans import QUERIES, audit_queries, serving_queries, text_queries
from peerlens.plans.panel import panel, snapshot
from peerlens.plans.peer_queries import FOUR, W, features, final_peers, ratios, vectors
from peerlens.sources.contexts import Contexts
from peerlens.sources.sealed import get_text, put_text, read_sealed, write_sealed
from peerlens.sources.snapshots import Versions

SF = "/root/testdata/sf0.001"
SPEC = {"weights": dict(W), "k": 10, "q33": 0.2, "q67": 0.5, "bound": 0.8, "tau": {"gross_margin": 0.1}, "floor": 0.3}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_target_is_ranked_like_all(spark):
    f, v = features(spark, SF), vectors(spark, SF)
    targets = spark.createDataFrame([(2000, 3), (2001, 3), (1999, 7), (1999, 999)], "as_of int, firm bigint")
    key = lambda d: sorted((r.as_of, r.firm, r["rank"], r.peer, r.sim, r.text) for r in d.collect())
    got = single.rank_targets(f, targets, W, 4, v)
    assert key(got) == key(B.ranked(f, W, 4, v).join(targets, ["as_of", "firm"], "left_semi")) and got.count() > 4
    assert single.rank_targets(f, targets, {"text": 1.0}, 2).where("sim > 0").isEmpty()
    with pytest.raises(ValueError):
        single.rank_targets(f, f.select("as_of", "firm"), FOUR, 4, most=3)


def test_a_report_reads_its_snapshot_and_makes_no_blocks(spark, tmp_path):
    names = ["Supplier#000000003", "Supplier#000000003 ", "supplier#000000001", "nobody"]
    d = serving_queries.firm_reports(spark, SF, names, 2000, SPEC)
    plan = plan_of(d)
    assert "FlatMapGroups" not in plan and "CartesianProduct" not in plan and re.search(r"l_shipdate#\d+ >= ", plan)
    got = {r.asked: r for r in d.collect()}
    assert [got[n].status for n in names] == ["ok", "ok", "ok", "not_found"] and got["nobody"].peers is None
    r = got[names[0]]
    want = final_peers(spark, SF).where("as_of = 2000 and firm = 3").orderBy("rank").collect()
    assert [(p.rank, p.peer, p.sim) for p in r.peers] == [(w["rank"], w.peer, w.sim) for w in want] and r.n_peers == len(want)
    assert all(sum(p.why) == pytest.approx(p.sim, abs=1e-8) for p in r.peers) and all(p.name.startswith("Supplier#") for p in r.peers)
    block = {x.ratio: x for x in S.ratio_block(ratios(spark, SF).where("as_of = 2000"), final_peers(spark, SF)).where("firm = 3").collect()}
    assert {x.ratio: (x.n, x.peer_median, x.deviation, x.direction) for x in r.ratios} == {k: (x.n, pytest.approx(x.peer_median) if x.peer_median is not None else None, pytest.approx(x.deviation) if x.deviation is not None else None, x.direction) for k, x in block.items()}
    assert r.confidence == ("HIGH" if r.cohesion >= 0.5 else "MEDIUM" if r.cohesion >= 0.2 else "LOW") and set(r.flagged) == {x.ratio for x in r.ratios if x.needs_check}
    assert all("text" not in p.top_axes or w.text >= SPEC["floor"] for p, w in zip(r.peers, want, strict=True))
    serving_queries.export_reports(d, str(tmp_path / "out"))
    made = {x.split("=")[1]: [json.loads(line) for f in os.listdir(tmp_path / "out" / x) if f.endswith(".txt") for line in open(tmp_path / "out" / x / f, encoding="utf-8")] for x in os.listdir(tmp_path / "out") if x.startswith("corp=")}
    assert set(made) == {"1", "3"} and len(made["3"]) == 1 and len(made["3"][0]["peers"]) == r.n_peers and made["3"][0]["ratios"][0]["ratio"] == r.ratios[0].ratio
    late = serving_queries.firm_reports(spark, SF, names[:1], 1995, SPEC).collect()
    assert [x.status for x in late] == ["not_rankable"]


def test_contexts_are_bounded_and_follow_their_files(spark, tmp_path):
    made, c = [], Contexts(2)

    def get(n):
        path = str(tmp_path / f"{n}.parquet")
        return c.get(spark, ("t", n), [path], lambda: (made.append(n), spark.read.parquet(path))[1])

    for n in "abc":
        spark.range(3).write.parquet(str(tmp_path / f"{n}.parquet"))
    first = get("a")
    assert get("b").count() == 3 and get("a") is first and made == ["a", "b"]
    assert get("c").count() == 3 and len(c.kept) == 2  # b goes, not a
    assert get("a") is first and first.storageLevel.useMemory and made == ["a", "b", "c"]
    get("b")
    assert made == ["a", "b", "c", "b"] and [k[2] for k in c.kept] == ["a", "b"]
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "a.parquet"))
    assert get("a").count() == 5 and len(c.kept) == 2 and made[-1] == "a"
    c.clear()
    assert not c.kept
    assert snapshot(spark, SF, 2000).count() == QUERIES["feature_panel"](spark, SF).where("as_of = 2000").count()


def test_features_of_the_phases_are_those_of_the_panel(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    phases = audit_queries.snapshot_builder(spark, SF)
    v.build("one", {k: p for k, p in phases.items() if k != "features"})  # a run that ended before its last phase
    assert [found for _, found in v.build("one", phases).values()] == [True] * 4 + [False]
    v.publish("one", list(phases))
    columns = ["as_of", "firm", "rcept_dt", "revenue", "cost", "growth", "seg_n", "seg_top", "seg_hhi", "code", "mktcap"]
    key = lambda d: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in d.select(columns).collect())
    assert key(v.read("features")) == key(panel(spark, SF))


def test_sealed_file(spark, tmp_path):
    path = str(tmp_path / "p.json")
    digest = write_sealed(spark, path, {"b": 1.5, "a": ["é"]})
    assert read_sealed(spark, path) == ({"a": ["é"], "b": 1.5}, digest) and get_text(spark, path) == '{"a":["é"],"b":1.5}'
    with pytest.raises(FileExistsError):
        write_sealed(spark, path, {})
    put_text(spark, path, '{"a":["é"],"b":1.6}')
    with pytest.raises(ValueError):
        read_sealed(spark, path)


@pytest.mark.parametrize("engine", ["axes", "baseline"])
def test_frozen_engines(spark, tmp_path, engine):
    sealed, years = str(tmp_path / "p.json"), [2000, 2001]
    write_sealed(spark, sealed, {"engine": engine, "weights": dict(FOUR), "k": 4, "penalty": 3.5, "tau": {"gross_margin": 0.05, "operating_margin": 0.05}})
    got, digest = text_queries.frozen_cases(spark, SF, sealed, years, str(tmp_path / "cases"))
    f, r = (d.where(F.col("as_of").isin(*years)) for d in (features(spark, SF), ratios(spark, SF)))
    p = B.ranked(f, FOUR, 4) if engine == "axes" else B.baseline(f, 4).withColumn("sim", F.lit(0.0))
    want = S.peer_cases(r, p, spark.createDataFrame([(3.5,)], "penalty double"))
    key = lambda d: sorted((x.as_of, x.firm, x.ratio, round(x.ape, 9), x.fail) for x in d.collect() if x.ratio in ("gross_margin", "operating_margin"))
    assert key(got) == key(want) and len(digest) == 64 and set(got.columns) >= {"ill", "ape"}


def test_altered_parameters_stop_the_holdout(spark, tmp_path, monkeypatch):
    sealed = str(tmp_path / "p.json")
    write_sealed(spark, sealed, {"engine": "none", "weights": {}, "k": 4, "penalty": 1.0, "tau": {}})
    with pytest.raises(ValueError, match="no engine"):
        text_queries.frozen_cases(spark, SF, sealed, [2000], str(tmp_path / "a"))
    put_text(spark, sealed, '{"engine":"axes"}')
    with pytest.raises(ValueError, match="sealed"):
        text_queries.frozen_cases(spark, SF, sealed, [2000], str(tmp_path / "b"))
    other = str(tmp_path / "q.json")
    write_sealed(spark, other, {"engine": "baseline", "weights": {}, "k": 4, "penalty": 1.0, "tau": {"gross_margin": 0.1}})
    real = S.flags

    def meddle(*a):  # while the cases are being made
        put_text(spark, other, "{}")
        return real(*a)

    monkeypatch.setattr(text_queries.S, "flags", meddle)
    with pytest.raises(ValueError, match="sealed"):
        text_queries.frozen_cases(spark, SF, other, [2000], str(tmp_path / "c"))


def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "lineitem", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def search_sql():
    """Every weighting of the five axes by joining all pairs, which is little work with ten firms."""
    grid = text_queries.weight_grid(len(W))
    rows = "(VALUES " + ", ".join(f"({i}, {', '.join(f'{x!r}::DOUBLE' for x in w)})" for i, w in enumerate(grid)) + ") AS w(g, w0, w1, w2, w3, w4)"
    sim = " + ".join(f"w{i} * {k}" for i, k in enumerate(W))
    return f"""{text_queries.FINAL}, {S.RATIOS_SQL}, g0 AS (SELECT g, as_of, firm, peer, round({sim}, 9) AS sim FROM scored CROSS JOIN {rows} WHERE as_of IN {DEFAULT.dev_years}),
    g1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, as_of, firm ORDER BY sim DESC, peer) AS rank FROM g0) WHERE rank <= {DEFAULT.k_final}),
    g2 AS (SELECT g, d.as_of, d.firm, d.ratio, d.value AS actual, median(r.value) AS pred, count(r.value) AS n FROM defined d JOIN g1 ON g1.as_of = d.as_of AND g1.firm = d.firm LEFT JOIN ratios r ON r.as_of = d.as_of AND r.firm = g1.peer AND r.ratio = d.ratio GROUP BY ALL)
    SELECT g, round(median(CASE WHEN n < {DEFAULT.min_peers} THEN penalty ELSE abs(pred - actual) / abs(actual) END), 6) AS ape FROM g2 CROSS JOIN pen GROUP BY g"""


def test_search_and_holdout_are_those_of_all_pairs(spark):
    want = dict(duck().sql(search_sql()).fetchall())
    got = {r.g: r.ape for r in QUERIES["weight_search_final"](spark, SF).collect()}
    assert len(want) == 2851 and got == pytest.approx(want, abs=2e-6)
    best = min(want, key=lambda g: (want[g], g))
    weights = dict(zip(W, text_queries.weight_grid(len(W))[best], strict=True))
    sql = text_queries.FINAL
    for a, x in W.items():
        sql = sql.replace(f"{x / sum(W.values())!r}::DOUBLE * {a}", f"{weights[a]!r}::DOUBLE * {a}")
    sql += f", {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {S.CASES_SQL} SELECT ratio, count(*), round(median(ape), 6), round(avg((NOT fail)::INT), 6) FROM cases WHERE as_of NOT IN {DEFAULT.dev_years} GROUP BY ratio"
    holdout = {r.ratio: (r.n, pytest.approx(r.overall, abs=2e-6), pytest.approx(r.coverage, abs=2e-6)) for r in QUERIES["holdout_frozen"](spark, SF).collect()}
    assert {r[0]: r[1:] for r in duck().sql(sql).fetchall()} == holdout
