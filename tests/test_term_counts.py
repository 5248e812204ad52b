"""Grams of documents: rows that share a document add up, nothing reaches over two texts, and no row for each gram is shuffled."""

from __future__ import annotations

from peerlens.operators import text as X


def test_counts_and_plan(spark):
    rows = [(1, "ab-c abc"), (1, "cab"), (2, "a"), (3, None), (4, "𝒳yz𝒳yz")]
    c = X.term_counts(spark.createDataFrame(rows, "doc bigint, text string").repartition(3), 3)
    assert sorted(map(tuple, c.collect())) == [(1, "abc", 2), (1, "bca", 1), (1, "cab", 2), (4, "yz𝒳", 1), (4, "z𝒳y", 1), (4, "𝒳yz", 2)]
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "gram" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
