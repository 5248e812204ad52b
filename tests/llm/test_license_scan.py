"""The license scan against a scan without gates and without an order of work."""

from __future__ import annotations

import random
import re
import re._parser as parser

import pytest

from peerlens.llm import license_scan
from peerlens.llm.license_rules import CLASSES, RULES

TEXTS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "CC-BY-NC-SA 4.0, or cc by sa 3.0", None, "", " ... ",
    "This work is licensed under the GNU General Public License, version 3.", "under the mit license under THE mit License; under the MIT licence", "the lesser GNU Lesser General Public License v2.1 or later",
    "SPDX-License-Identifier: GPL-2.0-or-later\nSPDX-License-Identifier: MIT", "mit licenseé, submit license, émit license", "Copyright (c) 2020 The Ünïcode Authors. All rights reserved. all rights reserved",
    "apache " * 5000 + "license version 2", "nothing of this kind stands here by the end of a common sentence",
]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def rank(h):
    return h[2].priority, h[0] - h[1], h[2].order


def not_suppressed(hits):
    return [h for h in hits if h[2].kind == "base" or not any(o[0] <= h[0] and o[1] >= h[1] and rank(o) < rank(h) for o in hits)]


def plain(t):
    """Words and detections by every rule's own pattern over words with single spaces, each two of them held against each other."""
    w = words(t)
    text = " ".join(w)
    hits = [(first := text[: m.start()].count(" "), first + m[0].count(" "), r) for r in RULES for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", text)]
    return len(w), sorted((a, b, r.order) for a, b, r in not_suppressed(hits))


def sample(items, rng, least):
    """A text that a parsed pattern matches."""
    out = ""
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "NOT_LITERAL":
            out += "x"
        elif op == "IN":
            one = [a for o, a in arg if str(o) == "LITERAL"] + [a[0] for o, a in arg if str(o) == "RANGE"]
            out += chr(rng.choice(one))
        elif op == "BRANCH":
            out += sample(rng.choice(arg[1]), rng, least)
        elif op == "SUBPATTERN":
            out += sample(arg[3], rng, least)
        elif op == "MAX_REPEAT":
            low, high, what = arg
            out += "".join(sample(what, rng, least) for _ in range(low if least else min(high, low + rng.randint(0, 2))))
        else:
            raise AssertionError(op)
    return out


def test_every_rule_matches_whole_words_behind_its_gate():
    rng, s = random.Random(5), license_scan.Scanner(tuple(RULES))
    assert len(RULES) > 300 and len({(r.label, r.pattern) for r in RULES}) == len(RULES)
    for r in RULES:
        for i in range(6):
            t = sample(parser.parse(r.pattern), rng, i == 0)
            assert r.gate in t.split(" "), (r, t)
            assert any(x.order == r.order for _, _, x in s.hits(("zz " + t + " zz").encode().split())), (r, t)
            assert not any(x.order == r.order and (a == 0) for a, _, x in s.hits(("z" + t).encode().split())), (r, t)


def test_survivors_are_those_of_all_pairs():
    rng = random.Random(1)
    for n in range(60):
        hits = [(a := rng.randint(0, 15), a + rng.randint(0, 6), rng.choice(RULES)) for _ in range(n)]
        hits = list({(a, b, r.order): (a, b, r) for a, b, r in hits}.values())
        assert sorted((a, b, r.order) for a, b, r in license_scan.survivors(hits)) == sorted((a, b, r.order) for a, b, r in not_suppressed(hits))


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i if i != 6 else None, t, "no", 1) for i, t in enumerate(TEXTS)]
    return license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string, Text string, detections int").repartition(3))


def test_scan_is_that_by_brute_force(scanned):
    got = {r.doc_id: r for r in scanned.collect()}
    for i, t in enumerate(TEXTS):
        r, (n, found) = got[i if i != 6 else None], plain(t)
        assert r.n_words == n and sorted((x.first, x.last, x.rule) for x in r.detections) == found, t
        for x in r.detections:
            assert words(t.encode()[x.from_byte : x.to_byte].decode()) == words(t)[x.first : x.last + 1]


def test_summary(scanned):
    got = {r.doc_id: r for r in license_scan.summary(scanned).collect()}
    row = lambda i: (got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels)
    assert row(0) == (1, 1, 1, "mit", "mit") and row(1) == (1, 3, 3, "apache-2", "apache-2") and row(2) == (1, 2, 2, "cc-by-nc", "cc-by-nc")
    assert row(3) == (1, 0, 0, "cc-by-nc", "cc-by-nc,cc-by-nc-sa,cc-by-sa") and row(7) == (0, None, None, "", "gpl-3")
    assert row(8)[:4] == (2, 0, 4, "mit") and row(9)[4] == "lgpl-2-1" and row(10)[4] == "gpl-2,mit" and got[10].score == 1.0
    assert row(11) == row(4) == row(5) == (0, None, None, "", "") == row(14) and got[4].score == 0.0 and got[4].n_words == 0
    assert row(12)[4] == "all-rights-reserved" and row(13) == (1, 4999, 4999, "apache-2", "apache-2")
    assert set(CLASSES.values()) <= {x / 100 for x in range(101)}


def test_empty_table_and_text_ids(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    r = license_scan.summary(license_scan.scan_licenses(spark.createDataFrame([("a", "MIT License"), ("a", "MIT License")], "doc_id string, text string"))).collect()
    assert [(x.doc_id, x.labels, x.score) for x in r] == [("a", "mit", CLASSES["name"])] * 2
