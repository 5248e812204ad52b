from __future__ import annotations

import numpy as np
import pytest

from peerlens.llm import line_dedup, mph

SCHEMA = "doc_id bigint, text string, Text int, source string"


def brute(rows):
    strip, out = " \t\n\x0b\f\r", []
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    order = lambda i: (1 << 63) - 1 if i is None else i
    holders = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(order(i))
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != order(i))]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


ROWS = [
    (3, "A shared line here\nonly in three\n\nshort", 1, "a"), (1, "  a SHARED line here\t\nown line of one\nown line of one", 1, "a"), (2, "a shared line here", 1, None),
    (2, "a shared line here", 1, None), (4, None, None, None), (5, "", 1, "x"), (None, "a shared line here\nonly of the null", 1, "x"), (None, "only of the null", 1, "y"),
    (6, "ÀB shared line\nàb shared line\nshort", 2, "x"), (7, "ÀB shared line\r\nx" + "y" * 100_000, 2, "x"), (8, "x" + "y" * 100_000, 2, "x"), (9, "\n\n\n", 2, "x"),
]


@pytest.mark.parametrize("shard", [1_000_000, 1])
def test_against_brute_force(spark, shard):
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = line_dedup.dedup_lines(spark, d, keys_a_shard=shard).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS)


def test_no_doc_id_stands_for_none(spark):
    rows = [((1 << 63) - 1, "a line that two share", 1, "x"), (None, "a line that two share", 1, "x"), (-(1 << 63), "of the first alone", 1, "x"), (None, "of the first alone\nx", 1, "x")]
    got = line_dedup.dedup_lines(spark, spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([((1 << 63) - 1, 0, "a line that two share"), (None, 1, ""), (-(1 << 63), 0, "of the first alone"), (None, 1, "x")], key=repr)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64))
    index = mph.build(keys)
    assert sorted(mph.slots(index, keys).tolist()) == list(range(len(keys)))
    assert len(mph.slots(mph.build(keys[:0]), keys[:3])) == 3
    with pytest.raises(ValueError):
        mph.build(np.array([1, 1], np.uint64))
