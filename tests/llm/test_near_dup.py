from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from peerlens.llm import components, near_dup


def brute(rows):
    """Classes by comparing all pairs, by the probability Jaccard similarity written out."""
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else (t or "")

    def same(a, b):
        if isinstance(a, str) or isinstance(b, str):
            return a == b
        return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a | b) for x in a.keys() & b.keys()) >= 0.8

    g, top = [(i, grams(t)) for i, t in rows], {}

    def root(i):
        while top.get(i, i) != i:
            i = top[i]
        return i

    for k, (i, a) in enumerate(g):
        for j, b in g[:k]:
            x, y = root(i), root(j)
            if x != y and same(a, b):
                top[max(x, y)] = min(x, y)
    return sorted((i, root(i)) for i, _ in rows)


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(12):
        text = [word() for _ in range(rng.choice([3, 60, 120]))]
        for _ in range(rng.randint(1, 8)):
            t = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
            rows.append((n, " ".join(t)))
            text, n = rng.choice([text, t]), n + 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "!!"), (n + 3, "one"), (n + 4, "One!"), (n + 5, "x y z x y z " * 40), (n + 6, "x y z x y z " * 30)]


def test_against_brute_force(spark):
    rows = rows_of(4)
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, key int, bands int").repartition(3)
    assert sorted(map(tuple, near_dup.near_duplicates(spark, d).collect())) == brute(rows)


def test_long_texts_and_largest_id(spark):
    words = [f"w{i}" for i in range(30_000)]
    other = list(words)
    for i in range(0, 30_000, 400):
        other[i] = "changed"
    last = (1 << 63) - 1
    rows = [(last, " ".join(words)), (5, " ".join(other)), (6, " ".join(words[:15_000])), (7, "z" * 200_000), (None, "z" * 200_000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dup.near_duplicates(spark, d).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(last, 5), (5, 5), (6, 6), (7, 7), (None, 7)], key=repr)


def test_groups_of_texts_are_split_and_chunked(spark):
    rows = rows_of(9)
    d = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    small = near_dup.ShingleSets(near_dup.pa.chunked_array([[[1, 2, 3, 4, 5, 6], [7], [1, 2, 3, 4, 5, 6]]]), 5, "count", 0)
    assert near_dup.similarity(small(0), small(2)) == 1 and near_dup.similarity(small(0), small(1)) == 0 and len(small.known) == 1
    assert sorted(map(tuple, near_dup.near_duplicates(spark, d).collect())) == brute(rows)


def probability_jaccard(a, b):
    """Sum over shared elements i of 1 / sum over all j of max(a_j / a_i, b_j / b_i); by plain counts, without the operator's code."""
    both = a.keys() | b.keys()
    by = sorted((a.get(x, 0) / b[x] if x in b else math.inf, a.get(x, 0), b.get(x, 0)) for x in both)
    more, less, total, k = sum(w for _, w, _ in by), 0, 0.0, 0
    while k < len(by):  # elements of one ratio share a denominator, up to their own weight
        j = k
        while j < len(by) and by[j][0] == by[k][0]:
            j += 1
        if 0 < by[k][0] < math.inf:
            total += sum(1 / (more / x + less / y) for _, x, y in by[k:j])
        more, less, k = more - sum(x for _, x, _ in by[k:j]), less + sum(y for _, _, y in by[k:j]), j
    return total


def links_of(rows):
    """All pairs that share a shingle and have a probability Jaccard similarity of 0.8 or more, of whole texts; nothing is left out beforehand."""
    grams, holders = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        if w:
            grams[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
            for x in grams[i]:
                holders.setdefault(x, []).append(i)
    met = {(a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k]}
    return [(a, b) for a, b in met if probability_jaccard(grams[a], grams[b]) >= 0.8]


def test_similarity_is_that_of_plain_counts():
    assert probability_jaccard({"a": 1}, {"a": 5}) == pytest.approx(1) and probability_jaccard({"a": 1}, {"b": 1}) == 0
    one = {"x": 1000.0, **{f"y{i}": 1.0 for i in range(100)}}
    assert probability_jaccard(one, {"x": 1000.0, **{f"z{i}": 1.0 for i in range(100)}}) == pytest.approx(1000 / 1200)  # 1 shared of 201 distinct
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = ({int(k): float(rng.integers(1, 5)) for k in rng.choice(30, 20, replace=False)} for _ in range(2))
        plain = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert probability_jaccard(a, b) == pytest.approx(plain) == near_dup.similarity(*arrays)


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    links = links_of([tuple(r) for r in docs.collect()])
    top = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark, docs).collect()}
    found = sum(top[a] == top[b] for a, b in links)
    print(f"{found} of {len(links)} links")
    assert len(links) > 100 and found >= 0.99 * len(links), (found, len(links))
    joined = {}
    for i, c in top.items():
        joined.setdefault(c, []).append(i)
    linked = {x for p in links for x in p}
    texts = dict(map(tuple, docs.collect()))
    assert all(len(m) == 1 or all(i in linked or (texts[i] or "") in {texts[j] or "" for j in m if j != i} for i in m) for m in joined.values())


def test_null_and_repeated_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words are in here too"), (None, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, near_dup.near_duplicates(spark, d).collect()), key=repr)
    assert got.count((2, 2)) == 2 and (3, 3) in got and len(got) == 5 and (None, 2) in got
    assert near_dup.near_duplicates(spark, d.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng, slots, errors = np.random.default_rng(1), 192, []
    for _ in range(40):
        a = rng.integers(1, 1 << 62, 200).astype(np.uint64)
        b = np.r_[a[:170], rng.integers(1, 1 << 62, 30).astype(np.uint64)]
        w = rng.integers(1, 4, 200).astype(float)
        x, y = (near_dup.signatures(e, w, np.zeros(200, int), 1, slots)[0] for e in (a, b))
        exact = near_dup.similarity(*((np.sort(e), w[np.argsort(e)]) for e in (a, b)))
        errors.append((x == y).mean() - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


@pytest.mark.parametrize("bound", [0, 1000])
def test_components_of_a_path_and_a_star(spark, bound):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark, spark.createDataFrame(edges, "a bigint, b bigint"), most_in_one_task=bound).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 150), 100)}
