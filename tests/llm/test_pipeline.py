"""The pipeline against a version by brute force, and each stage on rows that are odd."""

from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np

import corpus_pipeline
from peerlens.llm.quality import LEAST, RATIO
from peerlens.llm.queries import tokenizer_path

from .test_line_dedup import brute as brute_lines
from .test_near_dup import brute as brute_classes
from .test_operators import base_measures, words

SF = "/root/testdata/sf0.001"


def lexicon(docs, labels):
    """Words of labelled toxic texts, counted one by one."""
    toxic = {i: t for i, t in labels if t is not None}
    sides = [[set(words(t)) for i, t in docs if toxic.get(i) == k] for k in (1, 0)]
    seen = set().union(*sides[0])
    count = lambda w, side: sum(w in x for x in side)
    return {w for w in seen if (n := count(w, sides[0])) >= LEAST and n * (len(sides[1]) + 1) >= RATIO * (count(w, sides[1]) + 0.5) * (len(sides[0]) + 1)}


def keeps(text, bad_words):
    n, chars, symbols, dup, rep = base_measures(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bangs, upper = len(re.findall("!!", text or "")), len(re.findall("[A-Z]", text or ""))
    plain = words(text)
    found = sum(w in bad_words for w in plain)
    abuse = found > 0 and 100 * found >= len(plain)
    bad = n < 10 or 100 * rep > 20 * n or 10 * symbols > 3 * n or 10 * bangs > 2 * n or 10 * upper > 6 * chars or (len(lines) >= 4 and 10 * dup > 3 * len(lines)) or chars > 20 * n or 10 * chars < 15 * n or abuse
    return not bad


def test_pipeline_against_brute_force(spark):
    import sentencepiece

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    bad_words = lexicon(docs, duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    docs = [(i, t) for i, t in docs if keeps(t, bad_words)]
    docs = sorted((i, t) for i, _, _, t in brute_lines(docs))
    top = dict(brute_classes(docs))
    docs = [(i, t) for i, t in docs if top[i] == i]
    wins = set()
    for (t,) in items:
        w = words(t)
        wins |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in wins}
    docs = [(i, t) for i, t in docs if not any(tuple(w[k : k + n]) in wins for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = {}
    for i, t in docs:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 50 < len(want) < 200


def test_stages_keep_columns_and_take_odd_rows(spark):
    text = "these are plain words that make up a perfectly fine document number {} without anything odd in it at all"
    rows = [(None, None, "en", "s", None, 1), (1, "", "en", None, 0, 1), (2, text.format("two"), None, "s", 9, 1), (3, text.format("three other"), "en", "s", 9, 2), (3, text.format("three other"), "en", "s", 9, 2), (4, "z" * 50_000, "en", "s", 9, 2), (5, "own line here\n" + text.format("five") * 30, "en", "s", 9, 2)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, Text int").repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns and [k for _, k in out.dtypes] == [k for _, k in d.dtypes]
        out.collect()
        assert stage(spark, d.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() == len(rows)
    kept = corpus_pipeline.near_dedup(spark, d, SF).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None).count(3) == 1
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, d, SF).collect()} >= {2, 3}


def test_near_dedup_of_equal_rows_with_columns_that_have_no_order(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, {"a": 2}, 5), (1, text, {"a": 1}, 5), (1, text, {"a": 1}, None), (2, "another text of five or more words", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, meta map<string,int>, n_chars int")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id, r.meta, r.n_chars) for r in kept) == [(1, {"a": 1}, 5), (2, None, 1)]
