"""Hash trees, and the guard that reads a plan's scans."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from peerlens.config import SCORED_ACCOUNTS
from peerlens.operators import axes as A
from peerlens.operators import govern as G
from peerlens.operators import hashtree as H
from peerlens.plans import peer_queries as P
from peerlens.plans.panel import panel


def plain(rows, depth):
    """node -> digest, by recursion over plain lists."""
    md = lambda k: hashlib.md5(k.encode()).hexdigest()
    sha = lambda x: hashlib.sha256("\n".join(sorted(x)).encode()).hexdigest()

    def node(prefix):
        own = [(k, v) for k, v in rows if md(k).startswith(prefix)]
        if not own:
            return {}
        if len(prefix) == depth:
            return {prefix: sha(f"{k}:{v}" for k, v in own)}
        below = {}
        children = [f"{prefix}{c}" for c in "0123456789abcdef"]
        for c in children:
            below |= node(c)
        return below | {prefix: sha(f"{c}:{below[c]}" for c in children if c in below)}

    return node("")


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_tree_and_what_changed(spark, depth):
    rows = [(f"k{i}", str(i * 7)) for i in range(200)]
    tree = lambda x: H.tree(spark.createDataFrame(x, "k string, v string").repartition(3), F.col("k"), F.col("v"), depth)
    old = tree(rows)
    assert {r.node: r.digest for r in old.collect()} == plain(rows, depth) and old.where("level = 0").first().n == 200
    new = [(k, "x" if k == "k5" else v) for k, v in rows if k != "k9"] + [("new", "1")]
    got = {r.node for r in H.differing(old, tree(new)).collect()}
    want = {hashlib.md5(k.encode()).hexdigest()[:d] for k in ("k5", "k9", "new") for d in range(depth + 1)}
    assert got == want and H.differing(old, tree(rows[::-1])).count() == 0
    assert H.depth_for(10_000) == 0 and H.depth_for(10_001) == 1 and H.depth_for(10**9) == 5


def test_ranking_never_reads_what_is_predicted(spark):
    sf = "/root/testdata/sf0.001"
    f = P.features(spark, sf)
    read = {c for _, columns in G.scanned(f) for c in columns}
    assert {"revenue", "assets", "mktcap"} <= read and not read & set(P.HIDDEN) and len(P.HIDDEN) == len(SCORED_ACCOUNTS) - 1
    assert G.blind(f, P.HIDDEN) is f
    p = panel(spark, sf)
    for leak in P.HIDDEN:
        with pytest.raises(ValueError, match=leak):  # a scored account in the place of a feature
            G.blind(A.features(p.withColumn("growth", F.col("growth") + F.col(leak))), P.HIDDEN)
    with pytest.raises(ValueError):
        G.blind(f.join(p.where("cost > 0").select("as_of", "firm"), ["as_of", "firm"], "left_semi"), P.HIDDEN)
    with pytest.raises(ValueError, match="hidden table"):
        G.blind(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey"), [], ("lineitem",))
