from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from peerlens.llm import lm_score


def discounts(n):
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
    return [0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else k / 2, 0), k) for k in (1, 2, 3)]


def brute(rows, held):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in low(t)).split(" ") if w] + ["</s>"]
    train = [split(t) for i, t in rows if not held(i)]
    raw, pairs = Counter(w for x in train for w in x), Counter(p for x in train for p in zip(["<s>", *x], x, strict=False))
    total, kinds, conts = Counter(), defaultdict(Counter), Counter()
    for (u, w), c in pairs.items():
        total[u] += c
        kinds[u][min(c, 3)] += 1
        conts[w] += 1
    d2, d1 = (discounts(Counter(c.values())) for c in (pairs, conts))
    n, v, s = sum(raw.values()), len(raw), sum(conts.values())
    rest = sum(d1[min(c, 3)] for c in conts.values()) / s if s else 1

    def p1(w):
        c = conts[w]
        return ((c - d1[min(c, 3)]) / s if c else 0) + rest / (v + 1)

    def p2(u, w):
        if not total[u]:
            return p1(w)
        c = pairs[u, w]
        return (max(c - d2[min(c, 3)], 0) + sum(d2[k] * m for k, m in kinds[u].items()) * p1(w)) / total[u]

    out = {}
    for i, t in rows:
        x = split(t)
        out[i] = (len(x), sum(raw[w] > 0 for w in x), n, sum(math.log10((raw[w] + 1) / (n + 1 * (v + 1))) for w in x), sum(math.log10(p2(u, w)) for u, w in zip(["<s>", *x], x, strict=False)))
    if train:
        words = [*raw, "<unknown>"]
        for u in ["<s>", "a", "<unknown>"]:
            assert sum(p2(u, w) for w in words) == pytest.approx(1)
    return out


TEXTS = ["a b c a b", "A B\tc\nd", "", None, "x y x y x y z", "a b " * 300, "q" * 5000, "b a c unseen", "a b c a b", "d d d d e f g h i j", "É é a"]


@pytest.mark.parametrize("sizes", [{}, {"word_bytes": 40, "pair_bytes": 30, "buffer": 50}])
def test_against_brute_force(spark, sizes):
    rows = list(enumerate(TEXTS * 2))
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, Text int, tokens int").repartition(3)
    got = {r.doc_id: r for r in lm_score.score_documents(spark, d, F.col("doc_id") % 5 == 2, **sizes).collect()}
    want = brute(rows, lambda i: i % 5 == 2)
    assert got.keys() == want.keys()
    for i, w in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.held_out == (i % 5 == 2)
        assert r.base_score == pytest.approx(w[3]) and r.score == pytest.approx(w[4])


def test_no_training_text_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    (r,) = lm_score.score_documents(spark, d, F.lit(True)).collect()
    assert r.score == 0 and r.train_tokens == 0
    assert lm_score.score_documents(spark, d.limit(0), F.lit(False)).count() == 0
