"""Strings that hold each other, by q-grams and by comparing each two."""

from __future__ import annotations

import pytest

from peerlens.operators import qgrams


@pytest.mark.parametrize("q", [2, 3, 5])
def test_pairs_are_those_of_all_comparisons(spark, q):
    names = ["", "a", "ab", "abc", "abcabc", "xxabcxx", "bca", "가나다라", "나다", "cab", "ABC", None, "aaaa", "aaaaaaa", "abc"]
    asked = ["b", "ab", "abc", "다", "aaa", "zzz", "", None, "xxabcxx and more", "a"]
    n, a = (spark.createDataFrame([(s,) for s in x], "s string").repartition(3) for x in (names, asked))
    want = {(x, y) for x in names if x for y in asked if y and y in x}
    got = qgrams.holding(n, a, q)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, qgrams.either_way(n, a, q).collect())) == sorted(want | {(x, y) for x in names if x for y in asked if y and x in y})
    assert qgrams.holding(n, a.limit(0), q).count() == 0 == qgrams.holding(n.limit(0), a, q).count()
