"""What ranking, vectors and the panel read, write and shuffle; every pair looked at without a row for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.operators import axes as A
from peerlens.operators import blocks as B
from peerlens.operators import everypair as E
from peerlens.operators import text as X
from peerlens.plans import panel as P

from .test_blocks import SCHEMA


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def far(spark):
    """Four groups of firms that are far apart in size, and alike inside."""
    return spark.createDataFrame([(1, i, "0101", float(i // 10 * 50 + i % 10 / 100), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(40)], SCHEMA)


@pytest.mark.parametrize("weights", [None, {"scale": 1.0}])
def test_blocks_out_of_reach_are_not_read(spark, far, monkeypatch, weights):
    """The baseline read and weighed every block for every other."""
    kept = {}
    monkeypatch.setattr(B, "strips", lambda f, run, *a, **b: kept.update(run=run) or f)
    B.nearest(far, [(weights, 3)], [], None, (999, 2), 10)
    path, _, blocks = B.dealt(far, None, 10)
    codes, read = B.Codes((999, 2)), []
    ends = B.boxes(spark, path, False)
    own = B.Block(path, blocks[0], codes, False)

    def others(matters=None):
        yield own
        for j in blocks[1:]:
            if matters is None or matters(B.box(ends[j], codes)):
                read.append(j)
                yield B.Block(path, j, codes, False)

    assert sum(len(t) for t in kept["run"](own, others)) == 3 * len(own.firm)
    assert not read


def test_grams_are_not_shuffled(spark):
    """Texts and a row for each of their grams were shuffled."""
    docs = spark.createDataFrame([(i, f"abc{'xyz' * (i % 4)}abd") for i in range(9)], "doc bigint, text string")
    assert "Exchange" not in plan(X.tfidf(docs, 3, 50))[1]
    twice = docs.unionByName(docs.where("doc = 1"))
    whole = X.tfidf(twice, 3, 50).groupBy("doc", "gram").count().where("count > 1")
    assert whole.count() == 0


def test_lines_are_added_up_before_they_are_shuffled(spark):
    """All lines were shuffled to their parts first."""
    executed = plan(P.build_panel(spark, "/root/testdata/sf0.001"))[1]
    assert "SortMergeJoin [part" not in executed and "BroadcastHashJoin [part" in executed


@pytest.mark.parametrize("sizes", [(7, 5), (512, 512)])
def test_every_pair_is_looked_at(spark, sizes):
    """Against the join of pairs, with ties, missing values and blank codes."""
    rng = np.random.default_rng(5)
    rows = [(y, i, ["0101", "0102", "0201", ""][i % 4], *[None if rng.random() < 0.1 else float(round(rng.random(), 1)) for _ in range(7)]) for y in (1, 2) for i in range(40) if (i + y) % 9]
    f = spark.createDataFrame(rows, SCHEMA)
    w = {"industry": 0.3, "scale": 0.2, "mktcap": 0.2, "growth": 0.1}
    got = A.top_k(A.score_pairs(E.beside(E.shortlist(f, [w], 4, targets=sizes[0], peers=sizes[1]).drop("g"), f), w), 4)
    rows = lambda d: sorted((r.as_of, r.firm, r["rank"], r.peer, r.sim) for r in d.collect())
    assert rows(got) == rows(A.top_k(A.scored(f, w), 4))


def test_no_row_is_made_for_a_pair(spark):
    """What is shuffled grew with the square of the firms."""
    f = spark.createDataFrame([(1, i, "0101", *[float(i % 7)] * 7) for i in range(300)], SCHEMA)
    n = E.shortlist(f, [{"scale": 0.5, "growth": 0.5}], 4).groupBy("firm").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert n <= 8
