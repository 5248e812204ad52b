"""Names that someone asks for: few are sent to the universe, many go through the index; both find the same."""

from __future__ import annotations

from peerlens.plans.audit_queries import lookup


def test_few_names_shuffle_no_postings(spark):
    rows = [(i, f"Firm {i % 40}", i % 3 > 0) for i in range(60)] + [(99, "", True), (98, None, True)]
    u = spark.createDataFrame(rows, "firm bigint, name string, rankable boolean")
    names = ["firm1", "FIRM 1", "firm", " ", "nobody", "m3", "Firm 39", "irm2"]
    few, many = lookup(spark, u, names), lookup(spark, u, names, at_once=0)
    got = sorted(map(tuple, few.collect()))
    assert got == sorted(map(tuple, many.collect()))
    assert {r[0]: r[3] for r in got}["firm"] == 60 and {r[0]: r[3] for r in got}["m3"] == 12
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan(few) and "Generate" in plan(many)
