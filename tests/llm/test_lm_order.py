"""Models of order 3 and 4 against brute force."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from peerlens.llm import lm_score

from .test_lm_score import TEXTS, discounts


def brute(rows, held, n):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: ["<s>", *[w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in low(t)).split(" ") if w], "</s>"]
    train = [split(t) for i, t in rows if not held(i)]
    raw = {k: Counter(tuple(x[i : i + k]) for x in train for i in range(len(x) - k + 1)) for k in range(1, n + 1)}
    types = len({w for x in train for w in x[1:]})
    a = {n: raw[n]}
    for k in range(n - 1, 0, -1):
        a[k] = Counter(g[1:] for g in raw[k + 1])
        a[k].update({g: c for g, c in raw[k].items() if g[0] == "<s>" and k > 1})
    d = {k: discounts(Counter(a[k].values())) for k in a}
    by = {k: defaultdict(Counter) for k in a}
    for k in a:
        for g, c in a[k].items():
            by[k][g[:-1]][g[-1]] = c

    def p(h, w):
        k = len(h) + 1
        f = by[k].get(h)
        lower = 1 / (types + 1) if k == 1 else p(h[1:], w)
        if not f:
            return lower
        return (max(f[w] - d[k][min(f[w], 3)], 0) + sum(d[k][min(c, 3)] for c in f.values()) * lower) / sum(f.values())

    words = {w for x in train for w in x[1:]} | {"<unknown>"}
    for h in [("<s>",), ("a",), ("a", "b")[: n - 1], ("<s>", "a")[: n - 1]]:
        assert sum(p(h, w) for w in words) == pytest.approx(1)
    return {i: sum(math.log10(p(tuple(x[max(0, j - n + 1) : j]), x[j])) for j in range(1, len(x))) for i, x in ((i, split(t)) for i, t in rows)}


@pytest.mark.parametrize("order, sizes", [(2, {}), (3, {}), (3, {"word_bytes": 40, "pair_bytes": 30, "buffer": 50}), (4, {"pair_bytes": 100})])
def test_against_brute_force(spark, order, sizes):
    rows = list(enumerate([*TEXTS * 2, "a b c d", "b c unseen d"]))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm_score.score_documents(spark, d, F.col("doc_id") % 5 == 2, order=order, **sizes).collect()}
    assert got == pytest.approx(brute(rows, lambda i: i % 5 == 2, order))


def test_no_text_of_that_length(spark):
    d = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")
    got = lm_score.score_documents(spark, d, F.lit(False), order=4).collect()
    assert [r.score for r in got] == [pytest.approx(brute([(1, ""), (2, "")], lambda i: False, 4)[1])] * 2
