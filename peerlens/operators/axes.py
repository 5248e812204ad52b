"""Similarity axes: each a Column over a target's and a peer's features (columns with suffix _a and _b). Missing similarity is 0."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.config import DEFAULT


def guarded_log(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def robust_scale(x: str) -> Column:
    """IQR, else population deviation, else 1: an aggregate over a snapshot."""
    iqr = F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))
    std = F.stddev_pop(x)
    return F.when(iqr > 0, iqr).when(std > 0, std).otherwise(F.lit(1.0))


def features(p: DataFrame) -> DataFrame:
    """Per-firm values that the axes need, made once and not for each pair."""
    std = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(F.lit(1.0))
    stats = p.groupBy("as_of").agg(robust_scale("growth").alias("g_scale"), std("seg_n").alias("sd_n"), std("seg_top").alias("sd_top"), std("seg_hhi").alias("sd_hhi"))
    return p.join(stats, "as_of").select(
        "as_of", "firm", F.coalesce("code", F.lit("")).alias("code"), guarded_log(F.col("revenue")).alias("ln_rev"), guarded_log(F.col("assets")).alias("ln_ast"),
        guarded_log(F.col("mktcap")).alias("ln_cap"), (F.col("growth") / F.col("g_scale")).alias("g"),
        (F.col("seg_n") / F.col("sd_n")).alias("s_n"), (F.col("seg_top") / F.col("sd_top")).alias("s_top"), (F.col("seg_hhi") / F.col("sd_hhi")).alias("s_hhi"))


def _closeness(*names: str) -> Column:
    squares = [(F.col(f"{n}_a") - F.col(f"{n}_b")) * (F.col(f"{n}_a") - F.col(f"{n}_b")) for n in names]
    return F.coalesce(F.exp(-F.sqrt(reduce(lambda x, y: x + y, squares))), F.lit(0.0))


def industry(prefixes: tuple[int, ...] = DEFAULT.prefixes) -> Column:
    """1 for equal codes, less for each tier that only a shorter prefix shares; a blank code matches nothing."""
    a, b = F.col("code_a"), F.col("code_b")
    out = F.when((a == "") | (b == ""), 0.0)
    for tier, n in enumerate(prefixes):
        out = out.when(F.left(a, F.lit(n)) == F.left(b, F.lit(n)), 1.0 - tier / len(prefixes))
    return out.otherwise(0.0)


#: name -> Column over a pair; the text axis is joined to pairs as sim_text.
AXES: dict[str, Callable[[], Column]] = {
    "industry": industry,
    "scale": lambda: _closeness("ln_rev", "ln_ast"),
    "mktcap": lambda: _closeness("ln_cap"),
    "growth": lambda: _closeness("g"),
    "segment": lambda: _closeness("s_n", "s_top", "s_hhi"),
    "text": lambda: F.coalesce("sim_text", F.lit(0.0)),
}


def pairs(f: DataFrame, targets: DataFrame | None = None, block: int = 256) -> DataFrame:
    """All ordered pairs of different firms of a snapshot, for what has to see each pair in the JVM; blocks.py ranks without making them.

    Peers are sent to each block of about so many targets: the join has an equality on (snapshot, block), work is even over snapshots and blocks, whose number
    grows with the firms, and nothing that grows is broadcast.
    """
    a = f if targets is None else f.join(targets, ["as_of", "firm"], "left_semi")
    blocks = max(1, -(-a.groupBy("as_of").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] // block))
    left = a.select("as_of", F.pmod(F.xxhash64("firm"), F.lit(blocks)).alias("block"), "firm", *[F.col(c).alias(f"{c}_a") for c in f.columns if c not in ("as_of", "firm")])
    right = f.select("as_of", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.col("firm").alias("peer"), *[F.col(c).alias(f"{c}_b") for c in f.columns if c not in ("as_of", "firm")])
    return left.join(right, ["as_of", "block"]).where(F.col("firm") != F.col("peer"))


def scored(f: DataFrame, weights: dict[str, float], text: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """as_of, firm, peer, one column for each axis with a weight, sim (weighted sum, weights normalised, 9 decimals)."""
    p = pairs(f, targets=targets)
    if "text" in weights:
        p = p.join(text, ["firm", "peer"], "left") if text is not None else p.withColumn("sim_text", F.lit(0.0))
    return score_pairs(p, weights)


def score_pairs(p: DataFrame, weights: dict[str, float]) -> DataFrame:
    """scored() of given pairs, with the features of both firms."""
    total = sum(weights.values())
    w = {k: v / total if total > 0 else v for k, v in weights.items()}
    p = p.select("as_of", "firm", "peer", *[AXES[k]().alias(k) for k in w])
    return p.withColumn("sim", F.round(reduce(lambda x, y: x + y, [F.lit(v) * F.col(k) for k, v in w.items()]), 9))


def top_k(s: DataFrame, k: int, order: tuple[Column, ...] = ()) -> DataFrame:
    """The best k peers of each target, by similarity unless told otherwise. The rank filter stands right on the window, so Spark keeps k rows for each target before it shuffles."""
    w = Window.partitionBy("as_of", "firm").orderBy(*(order or (F.desc("sim"), F.asc("peer"))))
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def numbered(f: DataFrame) -> DataFrame:
    """as_of, firm, pos, n: the firms of each snapshot numbered from 0 on, by the first byte of an MD5 and then by firm, and how many there are. A task numbers one such byte's firms; a small table of counts says where each byte's numbers begin."""
    d = f.select("as_of", "firm").withColumn("part", F.left(F.md5(F.col("firm").cast("string").cast("binary")), F.lit(2)))
    sizes = d.groupBy("as_of", "part").agg(F.count("*").alias("size"))  # at most 256 rows a snapshot
    w = Window.partitionBy("as_of")
    begins = sizes.select("as_of", "part", (F.sum("size").over(w.orderBy("part")) - F.col("size")).alias("begin"), F.sum("size").over(w).alias("n"))
    own = d.withColumn("own", F.row_number().over(Window.partitionBy("as_of", "part").orderBy("firm")) - 1)
    return own.join(begins, ["as_of", "part"]).select("as_of", "firm", (F.col("begin") + F.col("own")).alias("pos"), "n")


def random_peers(f: DataFrame, k: int, seed: int) -> DataFrame:
    """as_of, firm, rank, peer: k peers of each target without replacement, the first places of a shuffle of the snapshot's firms that is keyed by seed, snapshot and target.

    Only the places drawn are ever made: the j-th is drawn among the numbers that are left, the target's own and those drawn before being skipped. N x k rows, no pairs.
    """
    d = numbered(f).withColumn("taken", F.array("pos"))
    for j in range(k):
        key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("as_of").cast("string"), F.col("firm").cast("string"), F.lit(str(j))).cast("binary"))
        left = F.col("n") - 1 - j
        first = F.when(left > 0, F.conv(F.left(key, F.lit(13)), 16, 10).cast("bigint") % left)
        place = F.aggregate(F.sort_array("taken"), first, lambda x, t: x + F.when(x >= t, 1).otherwise(0).cast("bigint"))
        d = d.withColumn("place", F.when(left > 0, place)).withColumn("taken", F.when(left > 0, F.array_append("taken", F.col("place"))).otherwise(F.col("taken")))
    each = d.select("as_of", "firm", F.posexplode(F.slice("taken", F.lit(2), F.size("taken"))).alias("i", "pos"))
    return each.join(numbered(f).select("as_of", "pos", F.col("firm").alias("peer")), ["as_of", "pos"]).select("as_of", "firm", (F.col("i") + 1).alias("rank"), "peer")


def random_sql(k: int, seed: int, name: str, source: str = "panel") -> str:
    """The same for DuckDB: name AS (as_of, firm, rank, peer)."""
    steps = f"""{name}_n AS (SELECT as_of, firm, row_number() OVER (PARTITION BY as_of ORDER BY left(md5(firm::VARCHAR), 2), firm) - 1 AS pos, count(*) OVER (PARTITION BY as_of) AS n FROM {source}),
{name}_0 AS (SELECT as_of, firm, n, [pos] AS taken FROM {name}_n)"""
    for j in range(k):
        draw = f"('0x' || left(md5(concat_ws('|', '{seed}', as_of::VARCHAR, firm::VARCHAR, '{j}')), 13))::BIGINT % (n - 1 - {j})"
        place = f"list_reduce(list_concat([{draw}], list_sort(taken)), lambda x, t: x + (x >= t)::BIGINT)"
        steps += f", {name}_{j + 1} AS (SELECT as_of, firm, n, CASE WHEN n - 1 - {j} > 0 THEN list_append(taken, {place}) ELSE taken END AS taken FROM {name}_{j})"
    return f"""{steps}, {name}_e AS (SELECT as_of, firm, unnest(taken[2:]) AS pos, generate_subscripts(taken[2:], 1) AS rank FROM {name}_{k}),
{name} AS (SELECT e.as_of, e.firm, e.rank, x.firm AS peer FROM {name}_e e JOIN {name}_n x ON x.as_of = e.as_of AND x.pos = e.pos)"""


_SQ = lambda n: f"(a.{n} - b.{n}) * (a.{n} - b.{n})"
#: For DuckDB, after PANEL_SQL: feat and the axes of a pair (a, b).
FEATURES_SQL = """
stats AS (SELECT as_of, CASE WHEN quantile_cont(growth, 0.75) - quantile_cont(growth, 0.25) > 0 THEN quantile_cont(growth, 0.75) - quantile_cont(growth, 0.25)
    WHEN stddev_pop(growth) > 0 THEN stddev_pop(growth) ELSE 1.0 END AS g_scale,
  CASE WHEN stddev_pop(seg_n) > 0 THEN stddev_pop(seg_n) ELSE 1.0 END AS sd_n, CASE WHEN stddev_pop(seg_top) > 0 THEN stddev_pop(seg_top) ELSE 1.0 END AS sd_top,
  CASE WHEN stddev_pop(seg_hhi) > 0 THEN stddev_pop(seg_hhi) ELSE 1.0 END AS sd_hhi FROM panel GROUP BY as_of),
feat AS (SELECT as_of, firm, coalesce(code, '') AS code, CASE WHEN revenue > 0 THEN ln(revenue) END AS ln_rev, CASE WHEN assets > 0 THEN ln(assets) END AS ln_ast,
  CASE WHEN mktcap > 0 THEN ln(mktcap) END AS ln_cap, growth / g_scale AS g, seg_n / sd_n AS s_n, seg_top / sd_top AS s_top, seg_hhi / sd_hhi AS s_hhi
  FROM panel JOIN stats USING (as_of))
"""
AXES_SQL = {
    "industry": "CASE WHEN a.code = '' OR b.code = '' THEN 0.0 WHEN a.code = b.code THEN 1.0 WHEN left(a.code, 2) = left(b.code, 2) THEN 0.5 ELSE 0.0 END::DOUBLE",
    "scale": f"coalesce(exp(-sqrt({_SQ('ln_rev')} + {_SQ('ln_ast')})), 0.0)",
    "mktcap": f"coalesce(exp(-sqrt({_SQ('ln_cap')})), 0.0)",
    "growth": f"coalesce(exp(-sqrt({_SQ('g')})), 0.0)",
    "segment": f"coalesce(exp(-sqrt({_SQ('s_n')} + {_SQ('s_top')} + {_SQ('s_hhi')})), 0.0)",
    "text": "coalesce(t.sim_text, 0.0)",
}


def scored_sql(weights: dict[str, float]) -> str:
    """scored AS (...), after FEATURES_SQL and, with a text axis, TEXT_SQL."""
    total = sum(weights.values())
    axes = ", ".join(f"{AXES_SQL[k]} AS {k}" for k in weights)
    text = "LEFT JOIN textsim t ON t.firm = a.firm AND t.peer = b.firm" if "text" in weights else ""
    sim = " + ".join(f"{v / total!r}::DOUBLE * {k}" for k, v in weights.items())
    return f"""scored AS (SELECT *, round({sim}, 9) AS sim FROM (
      SELECT a.as_of, a.firm, b.firm AS peer, {axes} FROM feat a JOIN feat b ON a.as_of = b.as_of AND a.firm <> b.firm {text}))"""


def top_k_sql(k: int, name: str = "peers", source: str = "scored", order: str = "sim DESC, peer") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, firm ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k})"
