"""Reports on single firms: a target is ranked against the other firms of its snapshot (1 x N), and one nested row says how it stands beside its peers.

The targets are the small, checked side of every join, so nothing is done for firms that nobody asked about, and no block of pairs is made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.config import DEFAULT, RATIOS

from . import axes as A
from . import score as S
from .relational import few

#: So many targets (firm and snapshot) may be asked for at once; blocks.ranked() ranks any number.
MOST = 100


def rank_targets(f: DataFrame, targets: DataFrame, weights: dict[str, float], k: int, vectors: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """as_of, firm, rank, peer, one column for each axis, sim: the k most similar peers of each target (as_of, firm). f: features of all firms; vectors: doc, gram, weight."""
    if not few(targets, most):
        raise ValueError(f"more than {most} targets; rank them with blocks.ranked()")
    chosen = f.join(F.broadcast(targets.select("as_of", "firm")), ["as_of", "firm"], "left_semi")
    values = [c for c in f.columns if c not in ("as_of", "firm")]
    mine = F.broadcast(chosen.select("as_of", "firm", *[F.col(c).alias(f"{c}_a") for c in values]))
    p = f.select("as_of", F.col("firm").alias("peer"), *[F.col(c).alias(f"{c}_b") for c in values]).join(mine, "as_of").where("firm <> peer")
    if "text" in weights:
        p = p.join(cosines(vectors, targets), ["firm", "peer"], "left") if vectors is not None else p.withColumn("sim_text", F.lit(0.0))
    total = sum(weights.values())
    share = {a: x / total if total > 0 else x for a, x in weights.items()}
    p = p.select("as_of", "firm", "peer", *[A.AXES[a]().alias(a) for a in share])
    p = p.withColumn("sim", F.round(reduce(lambda x, y: x + y, [F.lit(x) * F.col(a) for a, x in share.items()]), 9))
    return A.top_k(p, k)


def cosines(vectors: DataFrame, targets: DataFrame) -> DataFrame:
    """firm, peer, sim_text of the targets and every firm that shares a gram with one; the targets' grams (at most a vocabulary each) are sent to the vectors."""
    mine = vectors.join(F.broadcast(targets.select(F.col("firm").alias("doc")).distinct()), "doc", "left_semi")
    mine = F.broadcast(mine.select(F.col("doc").alias("firm"), "gram", F.col("weight").alias("w")))
    return vectors.join(mine, "gram").groupBy("firm", F.col("doc").alias("peer")).agg(F.round(F.sum(F.col("weight") * F.col("w")), 9).alias("sim_text"))


def _median(sorted_: Column) -> Column:
    n = F.size(sorted_)
    return F.when(n > 0, (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2)


def labels(p: Column, weights: dict[str, float], floor: float | None) -> Column:
    """The two axes that contribute most to a peer's score, the first named one among equals; text only from the floor of its raw similarity on."""
    total = sum(weights.values())
    each = [F.struct(F.round(F.lit(x / total) * p[a], 9).alias("v"), F.lit(len(weights) - i).alias("o"), F.lit(a).alias("l")) for i, (a, x) in enumerate(weights.items())]
    best = F.transform(F.slice(F.sort_array(F.filter(F.array(*each), lambda x: x["v"] > 0), asc=False), 1, 2), lambda x: x["l"])
    return best if floor is None or "text" not in weights else F.filter(best, lambda a: (a != "text") | (p["text"] >= F.lit(floor)))


def reports(panel: DataFrame, peers: DataFrame, spec: dict, min_peers: int = DEFAULT.min_peers) -> DataFrame:
    """One row for each target: as_of, firm, name, code, rcept_dt, cohesion, confidence, peers (in order, with rationale and labels), ratios beside them, flagged.

    panel: rows of the snapshots with accounts and names; peers: from rank_targets(); spec: weights, q33, q67, bound, tau by ratio, floor. Peers are joined once to the
    panel and gathered for each target; all else is computed on that one row.
    """
    weights, tau = spec["weights"], spec["tau"]
    value = lambda r: F.when(F.col(r.denominator) > 0, F.col(r.numerator) / F.col(r.denominator))
    small = lambda r: F.coalesce(F.when(F.col("assets") > 0, F.abs(r.numerator) / F.col("assets") < F.lit(tau.get(r.name)).cast("double")), F.lit(False))
    wide = panel.select("as_of", "firm", "name", "code", "rcept_dt", F.array(*[F.struct(F.lit(r.name).alias("ratio"), value(r).alias("value"), small(r).alias("ill")) for r in RATIOS]).alias("own"))
    side = F.broadcast(peers.select("as_of", F.col("firm").alias("target"), F.col("peer").alias("firm"), "rank", "sim", *weights))  # k rows for each of at most MOST targets
    j = wide.join(side, ["as_of", "firm"]).groupBy("as_of", "target").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("firm").alias("peer"), "name", "sim", *weights, F.col("own").alias("v")))).alias("p"))
    j = j.withColumnRenamed("target", "firm")
    d = wide.join(F.broadcast(j), ["as_of", "firm"]).withColumn("cohesion", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["sim"]) / F.size("p"), 9))
    d = d.withColumn("grade", S.grade(F.col("cohesion"), F.lit(spec["q33"]), F.lit(spec["q67"])))

    def beside(own: Column, i: Column) -> Column:
        theirs = F.sort_array(F.filter(F.transform("p", lambda x: F.get(x["v"], i)["value"]), lambda v: v.isNotNull()))
        return F.struct(own["ratio"].alias("ratio"), own["value"].alias("actual"), own["ill"].alias("ill"), F.size(theirs).cast("bigint").alias("n"), F.when(F.size(theirs) >= min_peers, _median(theirs)).alias("m"))

    def line(x: Column) -> Column:
        deviation = F.when(x["m"] != 0, F.abs(x["actual"] - x["m"]) / F.abs(x["m"]))
        check = F.coalesce(deviation >= F.lit(spec["bound"]), F.lit(False))
        note = F.when(x["m"].isNull(), "too few comparable peers").when(x["ill"], "small numerator").when(check, "far from peers").otherwise("")
        return F.struct(
            x["ratio"].alias("ratio"), x["actual"].alias("actual"), x["n"].alias("n"), x["m"].alias("peer_median"), deviation.alias("deviation"), F.when(x["m"].isNotNull(), F.when(x["actual"] > x["m"], "above").otherwise("below")).alias("direction"),
            check.alias("needs_check"), x["m"].isNotNull().alias("comparable"), F.when(x["ill"], "LOW").otherwise(F.col("grade")).alias("confidence"), note.alias("note"))

    cases = F.filter("own", lambda o: o["value"].isNotNull() & (o["value"] != 0))
    place = F.transform("own", lambda o: o["ratio"])
    d = d.withColumn("beside", F.transform(cases, lambda o: beside(o, (F.array_position(place, o["ratio"]) - 1).cast("int"))))
    d = d.withColumn("ratios", F.sort_array(F.transform("beside", line)))
    why = lambda x: F.struct(*[F.round(F.lit(w / sum(weights.values())) * x[a], 9).alias(a) for a, w in weights.items()])
    shown = F.transform("p", lambda x: F.struct(x["rank"].alias("rank"), x["peer"].alias("peer"), x["name"].alias("name"), x["sim"].alias("sim"), why(x).alias("why"), labels(x, weights, spec.get("floor")).alias("top_axes")))
    return d.select(
        "as_of", "firm", "name", "code", "rcept_dt", "cohesion", F.col("grade").alias("confidence"), F.size("p").cast("bigint").alias("n_peers"), shown.alias("peers"), "ratios",
        F.transform(F.filter("ratios", lambda x: x["needs_check"]), lambda x: x["ratio"]).alias("flagged"))
