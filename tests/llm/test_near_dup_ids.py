"""Texts without a doc_id, and texts that share one, are told apart."""

from __future__ import annotations

import random

import corpus_pipeline
from peerlens.llm import near_dup


def text(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))


ROWS = [(None, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (5, text(1)), (900, text(2)), (7, text(4)), (7, text(5)), (8, text(5)), (9, text(4) + " more"), (None, None), (None, "")]


def test_classes_are_of_texts(spark):
    d = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.own): r.class_id for r in near_dup.text_classes(spark, d).collect()}
    of = {(i, k): got[i, h] for i, t in ROWS for k, h in [(t, spark.range(1).select(near_dup.text_hash(near_dup.F.lit(t).cast("string"))).first()[0])]}
    assert of[None, text(1)] == of[5, text(1)] == 5 and of[None, text(2)] == of[900, text(2)] == 900
    assert of[7, text(4)] == of[9, text(4) + " more"] != of[7, text(5)] == of[8, text(5)]
    assert {of[7, text(4)], of[7, text(5)]} > {7} and of[None, text(3)] < 0
    assert len(near_dup.near_duplicates(spark, d).collect()) == len(ROWS) and len(set(of.values())) == 6


def test_stage_keeps_one_row_of_each_class(spark):
    d = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    kept = [(r.doc_id, r.text or "") for r in corpus_pipeline.near_dedup(spark, d, "").collect()]
    assert sorted(kept, key=repr) == sorted([(5, text(1)), (900, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (None, "")], key=repr)
