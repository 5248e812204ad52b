"""Ranking, prediction, scoring and reporting over the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.config import DEFAULT, SCALE_ACCOUNTS, SCORED_ACCOUNTS
from peerlens.operators import axes as A
from peerlens.operators import blocks as B
from peerlens.operators import govern as G
from peerlens.operators import resample
from peerlens.operators import score as S
from peerlens.operators import text as X
from peerlens.sources.contexts import stamp
from peerlens.sources.snapshots import stored

from .panel import PANEL_SQL, panel, read
from .registry import query

K, W = DEFAULT.k, DEFAULT.weights
#: Accounts that are predicted and that no ranking may read.
HIDDEN = [a for a in SCORED_ACCOUNTS if a not in SCALE_ACCOUNTS]
FOUR = {k: W[k] for k in ("industry", "scale", "mktcap", "growth")}
TEXT_SQL = X.text_sql("SELECT doc_id AS doc, text FROM documents JOIN supplier ON doc_id = s_suppkey", DEFAULT.gram, DEFAULT.vocabulary)
WITH = f"WITH {PANEL_SQL}, {A.FEATURES_SQL}"
PEERS = f"{WITH}, {A.scored_sql(FOUR)}, {A.top_k_sql(K)}"
PEERS10 = f"{WITH}, {A.scored_sql(FOUR)}, {A.top_k_sql(DEFAULT.k_final)}"
R6 = "round({0}, 6) AS {0}"


#: So many numbers of firms at most are sent to the documents.
FEW_FIRMS = 2_000_000
#: The vectors that were written last, by application, path and state of the tables.
_VECTORS: dict[tuple[str, str, str], DataFrame] = {}


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def features(spark: SparkSession, sf: str, years: tuple[int, ...] | None = None) -> DataFrame:
    """Of all snapshots or of some; what a snapshot's firms are scaled by is their own."""
    f = A.features(panel(spark, sf))
    return f if years is None else f.where(F.col("as_of").isin(*years))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """doc, gram, weight of the firms' texts; written once for a state of the tables, as most queries on texts need them more than once."""
    key = (spark.sparkContext.applicationId, sf, stamp(spark, [f"{sf}/{t}.parquet" for t in ("documents", "supplier")]))
    if key not in _VECTORS:
        firms = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc"))
        firms = F.broadcast(firms) if firms.count() <= FEW_FIRMS else firms  # numbers only; else texts would be shuffled
        docs = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text").join(firms, "doc")
        made = stored(X.tfidf(docs, DEFAULT.gram, DEFAULT.vocabulary))
        _VECTORS.clear()
        _VECTORS[key] = made
    return _VECTORS[key]


def peers(spark: SparkSession, sf: str, k: int = K, weights: dict[str, float] | None = None, years: tuple[int, ...] | None = None) -> DataFrame:
    w = weights or FOUR
    return B.ranked(G.blind(features(spark, sf, years), HIDDEN), w, k, vectors(spark, sf) if "text" in w else None)


def final_peers(spark: SparkSession, sf: str, years: tuple[int, ...] | None = None) -> DataFrame:
    """The engine with all weighted axes, text among them, and its own k; in all snapshots or in some."""
    return peers(spark, sf, DEFAULT.k_final, W, years)


def ratios(spark: SparkSession, sf: str) -> DataFrame:
    return S.ratio_table(panel(spark, sf))


def cases(spark: SparkSession, sf: str, k: int = K, aggregator: str = "median") -> DataFrame:
    r = ratios(spark, sf)
    return S.peer_cases(r, peers(spark, sf, k), S.penalty(r), aggregator)


def _axis(name: str):
    columns = f"SELECT a.as_of, a.firm, b.firm AS peer, round({A.AXES_SQL[name]}, 6) AS v FROM feat a JOIN feat b ON a.as_of = b.as_of AND a.firm <> b.firm"
    text = " LEFT JOIN textsim t ON t.firm = a.firm AND t.peer = b.firm" if name == "text" else ""
    cte = f"{WITH}, {TEXT_SQL}" if name == "text" else WITH

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return B.axis_profile(features(spark, sf), name, vectors(spark, sf) if name == "text" else None).select("as_of", "firm", *r6("best", "mean"))

    run.__name__ = f"axis_{name}"
    query(f"{cte} SELECT as_of, firm, round(max(v), 6) AS best, round(avg(v), 6) AS mean FROM ({columns}{text}) GROUP BY ALL")(run)


for _name in A.AXES:
    _axis(_name)


@query(f"WITH {PANEL_SQL} SELECT as_of, firm, code, rcept_dt::VARCHAR AS rcept_dt, revenue, assets, mktcap, {R6.format('growth')}, seg_n, seg_top, seg_hhi FROM panel")
def feature_panel(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).select("as_of", "firm", "code", F.col("rcept_dt").cast("string").alias("rcept_dt"), "revenue", "assets", "mktcap", *r6("growth"), "seg_n", "seg_top", "seg_hhi")


_TIER = "CASE WHEN a.code <> '' AND a.code = b.code THEN 0 WHEN a.code <> '' AND left(a.code, 2) = left(b.code, 2) THEN 1 ELSE 2 END"
BASE = f"""{WITH}, base AS (SELECT a.as_of, a.firm, b.firm AS peer, {_TIER} AS tier,
  coalesce(round(sqrt((a.ln_rev - b.ln_rev) * (a.ln_rev - b.ln_rev) + (a.ln_ast - b.ln_ast) * (a.ln_ast - b.ln_ast)), 9), 'Infinity'::DOUBLE) AS dist
  FROM feat a JOIN feat b ON a.as_of = b.as_of AND a.firm <> b.firm), {A.top_k_sql(K, 'peers', 'base', 'tier, dist, peer')}"""


@query(f"{BASE} SELECT as_of, firm, rank, peer, tier, round(dist, 6) AS dist FROM peers")
def baseline_peers(spark: SparkSession, sf: str) -> DataFrame:
    return B.baseline(features(spark, sf), K).select("as_of", "firm", "rank", "peer", "tier", F.round("dist", 6).alias("dist"))


@query(f"WITH {PANEL_SQL}, {A.random_sql(K, DEFAULT.seed, 'peers')} SELECT as_of, firm, rank, peer FROM peers")
def random_peers(spark: SparkSession, sf: str) -> DataFrame:
    return A.random_peers(panel(spark, sf), K, DEFAULT.seed)


@query(f"{WITH}, {TEXT_SQL}, {A.scored_sql(W)}, {A.top_k_sql(DEFAULT.k_final)} SELECT as_of, firm, rank, peer, round(sim, 6) AS sim FROM peers")
def similarity_peers(spark: SparkSession, sf: str) -> DataFrame:
    return final_peers(spark, sf).select("as_of", "firm", "rank", "peer", F.round("sim", 6).alias("sim"))


_TOTAL = sum(FOUR.values())
_WHY = ", ".join(f"round({v / _TOTAL!r}::DOUBLE * {k}, 6) AS why_{k}" for k, v in FOUR.items())


@query(f"{PEERS} SELECT as_of, firm, rank, peer, round(sim, 6) AS sim, {_WHY} FROM peers")
def peer_rationale(spark: SparkSession, sf: str) -> DataFrame:
    return peers(spark, sf).select("as_of", "firm", "rank", "peer", F.round("sim", 6).alias("sim"), *[F.round(F.lit(v / _TOTAL) * F.col(k), 6).alias(f"why_{k}") for k, v in FOUR.items()])


_LABELS = ", ".join(f"{{'v': round({v / _TOTAL!r}::DOUBLE * {k}, 9), 'o': {len(FOUR) - i}, 'l': '{k}'}}" for i, (k, v) in enumerate(FOUR.items()))


FINAL = f"{WITH}, {TEXT_SQL}, {A.scored_sql(W)}, {A.top_k_sql(DEFAULT.k_final)}"
_LABELLED = ", ".join(f"{{'v': round({v / sum(W.values())!r}::DOUBLE * {k}, 9), 'o': {len(W) - i}, 'l': '{k}'}}" for i, (k, v) in enumerate(W.items()))
_TOP = f"list_transform(list_reverse_sort(list_filter([{_LABELLED}], lambda x: x.v > 0))[1:2], lambda x: x.l)"


def labels(p: DataFrame, weights: dict[str, float]) -> DataFrame:
    """p with top_axes: labels of the two axes that contribute most to a peer's score, the first named one among equals."""
    total = sum(weights.values())
    each = [F.struct(F.round(F.lit(v / total) * F.col(k), 9).alias("v"), F.lit(len(weights) - i).alias("o"), F.lit(k).alias("l")) for i, (k, v) in enumerate(weights.items())]
    best = F.slice(F.sort_array(F.filter(F.array(*each), lambda x: x["v"] > 0), asc=False), 1, 2)
    return p.withColumn("top_axes", F.transform(best, lambda x: x["l"]))


@query(f"{FINAL} SELECT as_of, firm, peer, array_to_string({_TOP}, ',') AS top_axes FROM peers")
def top_axes(spark: SparkSession, sf: str) -> DataFrame:
    return labels(final_peers(spark, sf), W).select("as_of", "firm", "peer", F.array_join("top_axes", ",").alias("top_axes"))


@query(f"{FINAL} SELECT as_of, firm, rank, peer, CASE WHEN list_has_any({_TOP}, ['industry', 'text']) THEN 1 ELSE 2 END AS section FROM peers")
def display_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Section 1: industry or text is among a peer's labels; section 2: neither is. Ranks stay as they are."""
    shown = F.arrays_overlap("top_axes", F.array(F.lit("industry"), F.lit("text")))
    return labels(final_peers(spark, sf), W).select("as_of", "firm", "rank", "peer", F.when(shown, 1).otherwise(2).alias("section"))


@query(f"WITH {PANEL_SQL}, {S.RATIOS_SQL} SELECT as_of, firm, ratio, {R6.format('value')} FROM ratios")
def ratio_table(spark: SparkSession, sf: str) -> DataFrame:
    return ratios(spark, sf).select("as_of", "firm", "ratio", *r6("value"))


@query(f"WITH {PANEL_SQL}, {S.RATIOS_SQL} SELECT as_of, ratio, {R6.format('median')} FROM medians")
def market_medians(spark: SparkSession, sf: str) -> DataFrame:
    return S.market_medians(ratios(spark, sf)).select("as_of", "ratio", *r6("median"))


@query(f"WITH {PANEL_SQL}, {S.RATIOS_SQL} SELECT as_of, firm, ratio, {R6.format('ape')} FROM market")
def market_cases(spark: SparkSession, sf: str) -> DataFrame:
    return S.market_cases(ratios(spark, sf)).select("as_of", "firm", "ratio", *r6("ape"))


@query(f"WITH {PANEL_SQL}, {S.RATIOS_SQL} SELECT {R6.format('penalty')} FROM pen")
def penalty(spark: SparkSession, sf: str) -> DataFrame:
    return S.penalty(ratios(spark, sf)).select(*r6("penalty"))


@query(f"{PEERS}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {S.CASES_SQL} SELECT as_of, firm, ratio, {R6.format('ape')}, fail FROM cases")
def peer_cases(spark: SparkSession, sf: str) -> DataFrame:
    return cases(spark, sf).select("as_of", "firm", "ratio", *r6("ape"), "fail")


_AGG = "count(*) AS n, round(median(ape), 6) AS median_ape, " + ", ".join(f"round(avg((ape <= {w / 100})::INT), 6) AS within_{w}" for w in DEFAULT.within) + ", round(avg((NOT fail)::INT), 6) AS coverage"
_SCORES = ("median_ape", "within_10", "within_20", "within_30", "coverage")


@query(f"{PEERS}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {S.CASES_SQL} SELECT coalesce(ratio, 'all') AS ratio, {_AGG} FROM cases GROUP BY ROLLUP (ratio)")
def score_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return S.aggregate(cases(spark, sf)).select("ratio", "n", *r6(*_SCORES))


_N = len(S.RATIOS)


@query(f"""WITH {PANEL_SQL}, {S.RATIOS_SQL}, c AS (SELECT as_of, firm, count(value) AS defined FROM ratios GROUP BY ALL)
SELECT x.defined, count(c.defined) AS n, round(100.0 * count(c.defined) / sum(count(c.defined)) OVER (), 1) AS pct FROM (SELECT unnest(range(0, {_N + 1})) AS defined) x LEFT JOIN c ON c.defined = x.defined GROUP BY x.defined""")
def ratio_count_hist(spark: SparkSession, sf: str) -> DataFrame:
    """How many firms have 0, 1, ... defined ratios, zero counts included. The window runs over these few rows."""
    c = ratios(spark, sf).groupBy("as_of", "firm").agg(F.count("value").alias("defined")).groupBy("defined").agg(F.count("*").alias("c"))
    g = spark.range(_N + 1).withColumnRenamed("id", "defined").join(c, "defined", "left").select("defined", F.coalesce("c", F.lit(0)).alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))


def _aggregator(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = S.peer_values(ratios(spark, sf), peers(spark, sf, DEFAULT.k_final))
        return v.groupBy("as_of", "firm", "ratio").agg(F.round(S.AGGREGATORS[name](), 6).alias("pred"), F.count("v").alias("n"))

    run.__name__ = f"agg_{name}"
    if name == "wmedian":
        sql = f"""{PEERS10}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, c AS (SELECT *, sum(sim) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY as_of, firm, ratio ORDER BY v, sim ROWS UNBOUNDED PRECEDING) AS cum,
          sum(sim) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY as_of, firm, ratio) AS total FROM pv)
        SELECT as_of, firm, ratio, round(CASE WHEN max(total) > 0 THEN min(v) FILTER (WHERE cum >= total / 2) ELSE median(v) END, 6) AS pred, count(v) AS n FROM c GROUP BY ALL"""
    else:
        sql = f"{PEERS10}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL} SELECT as_of, firm, ratio, round({S.AGGREGATORS_SQL[name]}, 6) AS pred, count(v) AS n FROM pv GROUP BY ALL"
    query(sql)(run)


for _name in S.AGGREGATORS:
    _aggregator(_name)

_GRID = [3, 5, 7, 10]
_WMEDIAN = """CASE WHEN max(total) > 0 THEN min(v) FILTER (WHERE cum >= total / 2) ELSE median(v) END"""
_METHODS = " UNION ALL ".join(f"SELECT as_of, firm, ratio, actual, k, '{m}' AS method, {x} AS pred, count(v) AS n FROM kv GROUP BY as_of, firm, ratio, actual, k" for m, x in {**S.AGGREGATORS_SQL, "wmedian": _WMEDIAN}.items())


@query(f"""{PEERS10}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, kv AS (SELECT pv.*, k, sum(sim) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY as_of, firm, ratio, k ORDER BY v, sim ROWS UNBOUNDED PRECEDING) AS cum,
  sum(sim) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY as_of, firm, ratio, k) AS total FROM pv JOIN (SELECT unnest({_GRID}) AS k) ON rank <= k), g AS ({_METHODS})
SELECT method, k, count(*) AS n, round(median(CASE WHEN n < {DEFAULT.min_peers} THEN penalty ELSE abs(pred - actual) / abs(actual) END), 6) AS median_ape FROM g CROSS JOIN pen GROUP BY method, k""")
def agg_k_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregators by k: peers are ranked once, and a rank belongs to every k that it doesn't exceed."""
    r = ratios(spark, sf)
    v = S.peer_values(r, peers(spark, sf, max(_GRID)))
    v = v.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, _GRID)), lambda k: F.col("rank") <= k)))
    g = v.groupBy("as_of", "firm", "ratio", "actual", "k").agg(*[f().alias(m) for m, f in S.AGGREGATORS.items()], F.count("v").alias("n"))
    g = g.unpivot(["as_of", "firm", "ratio", "actual", "k", "n"], list(S.AGGREGATORS), "method", "pred").crossJoin(F.broadcast(S.penalty(r)))  # one row
    err = F.when(F.col("n") < DEFAULT.min_peers, F.col("penalty")).otherwise(S.ape(F.col("pred"), F.col("actual")))
    return g.groupBy("method", "k").agg(F.count("*").alias("n"), F.round(F.median(err), 6).alias("median_ape"))


_TAU = f"tau AS (SELECT ratio, quantile_cont(abs(num) / assets, {DEFAULT.ill_quantile}) AS tau FROM defined WHERE as_of IN {DEFAULT.dev_years} AND assets > 0 GROUP BY ratio), flags AS (SELECT as_of, firm, ratio, coalesce(CASE WHEN assets > 0 THEN abs(num) / assets < tau END, false) AS ill FROM defined JOIN tau USING (ratio))"


@query(f"WITH {PANEL_SQL}, {S.RATIOS_SQL}, {_TAU} SELECT as_of, firm, ratio, ill FROM flags")
def separation_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Ill-conditioned cases, by thresholds frozen on the dev snapshots and applied to all."""
    r = ratios(spark, sf)
    return S.flags(r, S.ill_thresholds(r))


@query(f"""{PEERS}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {S.CASES_SQL}, {_TAU}
SELECT c.as_of IN {DEFAULT.dev_years} AS dev, count(*) AS n, round(median(ape), 6) AS overall, round(median(ape) FILTER (WHERE NOT ill), 6) AS stable, round(avg(ill::INT), 6) AS excluded
FROM cases c JOIN flags USING (as_of, firm, ratio) GROUP BY 1""")
def split_report(spark: SparkSession, sf: str) -> DataFrame:
    """Dev and holdout apart: median error over all and over stable cases. Penalty and thresholds come from dev."""
    r = ratios(spark, sf)
    c = S.peer_cases(r, peers(spark, sf), S.penalty(r)).join(S.flags(r, S.ill_thresholds(r)), ["as_of", "firm", "ratio"])
    return c.groupBy(F.col("as_of").isin(*DEFAULT.dev_years).alias("dev")).agg(F.count("*").alias("n"), F.round(F.median("ape"), 6).alias("overall"), F.round(F.median(F.when(~F.col("ill"), F.col("ape"))), 6).alias("stable"), F.round(F.avg(F.col("ill").cast("int")), 6).alias("excluded"))


@query(f"{FINAL}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {S.CASES_SQL} SELECT coalesce(ratio, 'all') AS ratio, {_AGG} FROM cases GROUP BY ROLLUP (ratio)")
def score_final(spark: SparkSession, sf: str) -> DataFrame:
    """The final engine (all weighted axes with text, its own k) scored as score_aggregate() does."""
    r = ratios(spark, sf)
    return S.aggregate(S.peer_cases(r, final_peers(spark, sf), S.penalty(r))).select("ratio", "n", *r6(*_SCORES))


@query(f"""{FINAL}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {S.CASES_SQL}, {_TAU}
SELECT c.as_of IN {DEFAULT.dev_years} AS dev, c.ratio, count(*) AS n, round(median(ape), 6) AS overall, round(median(ape) FILTER (WHERE NOT ill), 6) AS stable, round(avg(ill::INT), 6) AS excluded
FROM cases c JOIN flags USING (as_of, firm, ratio) GROUP BY 1, 2""")
def split_report_final(spark: SparkSession, sf: str) -> DataFrame:
    """The final engine's errors by ratio, dev and holdout apart, over all and over stable cases."""
    r = ratios(spark, sf)
    c = S.peer_cases(r, final_peers(spark, sf), S.penalty(r)).join(S.flags(r, S.ill_thresholds(r)), ["as_of", "firm", "ratio"])
    return c.groupBy(F.col("as_of").isin(*DEFAULT.dev_years).alias("dev"), "ratio").agg(F.count("*").alias("n"), F.round(F.median("ape"), 6).alias("overall"), F.round(F.median(F.when(~F.col("ill"), F.col("ape"))), 6).alias("stable"), F.round(F.avg(F.col("ill").cast("int")), 6).alias("excluded"))


_COH = f"coh AS (SELECT as_of, firm, round(avg(sim), 9) AS cohesion FROM peers GROUP BY ALL), th AS (SELECT quantile_cont(cohesion, 0.33) AS q33, quantile_cont(cohesion, 0.67) AS q67 FROM coh WHERE as_of IN {DEFAULT.dev_years})"


def cohesion_bounds(c: DataFrame) -> DataFrame:
    return c.where(F.col("as_of").isin(*DEFAULT.dev_years)).agg(F.percentile("cohesion", F.lit(0.33)).alias("q33"), F.percentile("cohesion", F.lit(0.67)).alias("q67"))


@query(f"{PEERS}, {_COH} SELECT as_of, firm, round(cohesion, 6) AS cohesion, CASE WHEN cohesion >= q67 THEN 'HIGH' WHEN cohesion >= q33 THEN 'MEDIUM' ELSE 'LOW' END AS grade FROM coh CROSS JOIN th")
def cohesion_grade(spark: SparkSession, sf: str) -> DataFrame:
    c = S.cohesion(peers(spark, sf))
    g = c.crossJoin(F.broadcast(cohesion_bounds(c)))  # one row
    return g.select("as_of", "firm", F.round("cohesion", 6).alias("cohesion"), S.grade(F.col("cohesion"), F.col("q33"), F.col("q67")).alias("grade"))


_BLOCK = f"""blk AS (SELECT as_of, firm, ratio, actual, count(v) AS n, CASE WHEN count(v) >= {DEFAULT.min_peers} THEN median(v) END AS peer_median FROM pv GROUP BY ALL),
dev AS (SELECT *, CASE WHEN peer_median <> 0 THEN abs(actual - peer_median) / abs(peer_median) END AS deviation FROM blk),
dth AS (SELECT quantile_cont(deviation, 0.9) AS bound FROM dev WHERE as_of IN {DEFAULT.dev_years})"""


@query(f"{PEERS}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {_COH}, {_BLOCK} SELECT round(q33, 6) AS q33, round(q67, 6) AS q67, round(bound, 6) AS deviation_bound FROM th CROSS JOIN dth")
def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    p = peers(spark, sf)
    dev = S.ratio_block(ratios(spark, sf), p).where(F.col("as_of").isin(*DEFAULT.dev_years)).agg(F.round(F.percentile("deviation", F.lit(0.9)), 6).alias("deviation_bound"))
    return cohesion_bounds(S.cohesion(p)).select(*r6("q33", "q67")).crossJoin(dev)  # one row each


@query(f"""{PEERS}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {_COH}, {_BLOCK}, {_TAU}
SELECT as_of, firm, ratio, round(actual, 6) AS actual, n, round(peer_median, 6) AS peer_median, round(deviation, 6) AS deviation,
  CASE WHEN peer_median IS NOT NULL THEN CASE WHEN actual > peer_median THEN 'above' ELSE 'below' END END AS direction, deviation >= bound AS needs_check, peer_median IS NOT NULL AS comparable,
  CASE WHEN ill THEN 'LOW' WHEN cohesion >= q67 THEN 'HIGH' WHEN cohesion >= q33 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN peer_median IS NULL THEN 'too few comparable peers' WHEN ill THEN 'small numerator' WHEN deviation >= bound THEN 'far from peers' ELSE '' END AS note
FROM dev CROSS JOIN dth JOIN coh USING (as_of, firm) CROSS JOIN th JOIN flags USING (as_of, firm, ratio)""")
def ratio_block(spark: SparkSession, sf: str) -> DataFrame:
    """Each case beside its peers: direction and check only where enough peers are comparable; an ill-conditioned ratio has low confidence whatever the group's grade."""
    r, p = ratios(spark, sf), stored(peers(spark, sf))  # used three times
    b, c = S.ratio_block(r, p), S.cohesion(p)
    bound = b.where(F.col("as_of").isin(*DEFAULT.dev_years)).agg(F.percentile("deviation", F.lit(0.9)).alias("bound"))
    j = b.crossJoin(F.broadcast(bound)).join(c.crossJoin(F.broadcast(cohesion_bounds(c))), ["as_of", "firm"]).join(S.flags(r, S.ill_thresholds(r)), ["as_of", "firm", "ratio"])  # one row each
    check, short = F.col("deviation") >= F.col("bound"), F.col("peer_median").isNull()
    note = F.when(short, "too few comparable peers").when(F.col("ill"), "small numerator").when(check, "far from peers").otherwise("")
    sure = F.when(F.col("ill"), "LOW").otherwise(S.grade(F.col("cohesion"), F.col("q33"), F.col("q67")))
    return j.select("as_of", "firm", "ratio", *r6("actual"), "n", *r6("peer_median", "deviation"), "direction", check.alias("needs_check"), (~short).alias("comparable"), sure.alias("confidence"), note.alias("note"))


@query(f"""{PEERS}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {_BLOCK} SELECT as_of, firm, array_to_string(list_sort(list(ratio)), ',') AS flagged FROM dev CROSS JOIN dth WHERE deviation >= bound GROUP BY ALL""")
def flag_list(spark: SparkSession, sf: str) -> DataFrame:
    return ratio_block(spark, sf).where("needs_check").groupBy("as_of", "firm").agg(F.array_join(F.sort_array(F.collect_list("ratio")), ",").alias("flagged"))


@query(f"""{PEERS}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {S.CASES_SQL}, t AS (SELECT as_of, firm, round(avg(ape), 9) AS mean_ape FROM cases GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY mean_ape DESC, as_of) AS rn FROM t) SELECT as_of, firm, round(mean_ape, 6) AS mean_ape FROM w WHERE rn = 1 ORDER BY w.mean_ape DESC, firm LIMIT 20""")
def worst_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 firms with the largest mean error, each in its worst snapshot."""
    t = cases(spark, sf).groupBy("as_of", "firm").agg(F.round(F.avg("ape"), 9).alias("mean_ape"))
    w = t.groupBy("firm").agg(F.max(F.struct("mean_ape", -F.col("as_of"))).alias("x")).select((-F.col("x.col2")).alias("as_of"), "firm", F.col("x.mean_ape").alias("mean_ape"))
    return w.orderBy(F.desc("mean_ape"), F.asc("firm")).limit(20).select("as_of", "firm", *r6("mean_ape"))


_OFF = {k: {a: v for a, v in FOUR.items() if a != k} for k in FOUR}
_OFF_SQL = ", ".join(f"{A.scored_sql(w).replace('scored AS', f'scored_{k} AS', 1)}, {A.top_k_sql(K, f'peers_{k}', f'scored_{k}')}" for k, w in _OFF.items())


def _cases_of(tag: str, source: str) -> str:
    return (S.PEER_VALUES_SQL.replace("pv AS", f"pv_{tag} AS").replace("JOIN peers p", f"JOIN {source} p").replace("p.sim", "0.0 AS sim") + ", " + S.CASES_SQL.replace("cases AS", f"cases_{tag} AS").replace("FROM pv ", f"FROM pv_{tag} "))


_EACH_OFF = " UNION ALL ".join(f"SELECT '{k}' AS axis, * FROM cases_{k}" for k in _OFF)


@query(f"""{PEERS}, {_OFF_SQL}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {S.CASES_SQL}, {", ".join(_cases_of(k, f"peers_{k}") for k in _OFF)}, off AS ({_EACH_OFF})
SELECT axis, ratio, count(*) AS n, round(median(a.ape), 6) AS with_axis, round(median(b.ape), 6) AS without_axis, round(avg(b.ape - a.ape), 6) AS benefit, round(corr(a.ape, b.ape), 6) AS r
FROM cases a JOIN off b USING (as_of, firm, ratio) GROUP BY axis, ratio""")
def axis_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Each axis taken out in turn, the other weights normalised again, peers ranked and scored anew; errors compared case by case. All engines are ranked in one pass over the blocks."""
    r = ratios(spark, sf)
    specs = {"": (FOUR, K), **{k: (w, K) for k, w in _OFF.items()}}
    c = stored(S.peer_cases(r, B.engines(features(spark, sf), specs), S.penalty(r), by=("engine",)))  # used twice
    off = c.where("engine <> ''").select(F.col("engine").alias("axis"), "as_of", "firm", "ratio", F.col("ape").alias("off"))
    return c.where("engine = ''").join(off, ["as_of", "firm", "ratio"]).groupBy("axis", "ratio").agg(F.count("*").alias("n"), F.round(F.median("ape"), 6).alias("with_axis"), F.round(F.median("off"), 6).alias("without_axis"), F.round(F.avg(F.col("off") - F.col("ape")), 6).alias("benefit"), F.round(F.corr("ape", "off"), 6).alias("r"))


_OFF_W = {k: {a: v for a, v in W.items() if a != k} for k in W}
_OFF_W_SQL = ", ".join(f"{A.scored_sql(w).replace('scored AS', f'scored_{k} AS', 1)}, {A.top_k_sql(DEFAULT.k_final, f'peers_{k}', f'scored_{k}')}" for k, w in _OFF_W.items())
_EACH_OFF_W = " UNION ALL ".join(f"SELECT '{k}' AS axis, * FROM cases_{k}" for k in _OFF_W)


@query(f"""{FINAL}, {_OFF_W_SQL}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {S.CASES_SQL}, {", ".join(_cases_of(k, f"peers_{k}") for k in _OFF_W)}, off AS ({_EACH_OFF_W})
SELECT axis, count(*) AS n, round(median(a.ape), 6) AS with_axis, round(median(b.ape), 6) AS without_axis, round(avg(b.ape - a.ape), 6) AS benefit FROM cases a JOIN off b USING (as_of, firm, ratio) GROUP BY axis""")
def axis_ablation_final(spark: SparkSession, sf: str) -> DataFrame:
    """The final engine with each of its five axes taken out in turn, text among them; one pass over the blocks for all six engines."""
    r = ratios(spark, sf)
    specs = {"": (W, DEFAULT.k_final), **{k: (w, DEFAULT.k_final) for k, w in _OFF_W.items()}}
    c = stored(S.peer_cases(r, B.engines(G.blind(features(spark, sf), HIDDEN), specs, vectors(spark, sf)), S.penalty(r), by=("engine",)))  # used twice
    off = c.where("engine <> ''").select(F.col("engine").alias("axis"), "as_of", "firm", "ratio", F.col("ape").alias("off"))
    j = c.where("engine = ''").join(off, ["as_of", "firm", "ratio"])
    return j.groupBy("axis").agg(F.count("*").alias("n"), F.round(F.median("ape"), 6).alias("with_axis"), F.round(F.median("off"), 6).alias("without_axis"), F.round(F.avg(F.col("off") - F.col("ape")), 6).alias("benefit"))


_ON = ", ".join(_cases_of(k, f"peers_{k}") for k in ("growth",))


@query(f"""{PEERS}, {_OFF_SQL}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {S.CASES_SQL}, {_ON},
t AS (SELECT a.as_of, a.firm, round(avg(b.ape - a.ape), 9) AS benefit, any_value(abs(p.growth)) AS g FROM cases a JOIN cases_growth b USING (as_of, firm, ratio) JOIN panel p USING (as_of, firm) WHERE p.growth IS NOT NULL GROUP BY a.as_of, a.firm),
m AS (SELECT median(g) AS half FROM t) SELECT count(*) AS n, round(corr(g, benefit), 6) AS r, round(avg(benefit) FILTER (WHERE g >= half), 6) AS fast, round(avg(benefit) FILTER (WHERE g < half), 6) AS slow FROM t CROSS JOIN m""")
def ablation_by_growth(spark: SparkSession, sf: str) -> DataFrame:
    """What the growth axis is worth to a target, averaged over its ratios, beside how fast the target grows: correlation, and means on both sides of the median growth."""
    r = ratios(spark, sf)
    c = S.peer_cases(r, B.engines(features(spark, sf), {"on": (FOUR, K), "off": (_OFF["growth"], K)}), S.penalty(r), by=("engine",))
    e = c.groupBy("as_of", "firm", "ratio").agg(F.max(F.when(F.col("engine") == "on", F.col("ape"))).alias("on"), F.max(F.when(F.col("engine") == "off", F.col("ape"))).alias("off"))
    g = panel(spark, sf).where("growth is not null").select("as_of", "firm", F.abs("growth").alias("g"))
    t = e.join(g, ["as_of", "firm"]).groupBy("as_of", "firm", "g").agg(F.round(F.avg(F.col("off") - F.col("on")), 9).alias("benefit"))
    t = stored(t)  # used twice
    t = t.crossJoin(F.broadcast(t.agg(F.median("g").alias("half"))))  # one row
    side = lambda c: F.round(F.avg(F.when(c, F.col("benefit"))), 6)
    return t.agg(F.count("*").alias("n"), F.round(F.corr("g", "benefit"), 6).alias("r"), side(F.col("g") >= F.col("half")).alias("fast"), side(F.col("g") < F.col("half")).alias("slow"))


_RANDOM = A.random_sql(K, DEFAULT.seed, "rpeers")
_BASEP = BASE[len(WITH) + 2 :].replace("peers AS", "bpeers AS")
_FINALP = f"{A.scored_sql(W).replace('scored AS', 'scored_final AS', 1)}, {A.top_k_sql(DEFAULT.k_final, 'fpeers', 'scored_final')}"


@query(f"""{WITH}, {TEXT_SQL}, {A.scored_sql(FOUR)}, {A.top_k_sql(K)}, {_FINALP}, {_RANDOM}, {_BASEP}, {S.RATIOS_SQL}, {_cases_of('fin', 'fpeers')}, {_cases_of('sim', 'peers')}, {_cases_of('rnd', 'rpeers')}, {_cases_of('base', 'bpeers')},
every AS (SELECT 'similarity' AS engine, * FROM cases_sim UNION ALL SELECT 'final', * FROM cases_fin UNION ALL SELECT 'random', * FROM cases_rnd UNION ALL SELECT 'baseline', * FROM cases_base UNION ALL SELECT 'market', as_of, firm, ratio, ape, false FROM market)
SELECT engine, coalesce(ratio, 'all') AS ratio, {_AGG} FROM every GROUP BY GROUPING SETS ((engine, ratio), (engine))""")
def showdown(spark: SparkSession, sf: str) -> DataFrame:
    """Engines and controls side by side on the same cases and penalty: ranked in one pass over the blocks, scored in one."""
    r, f = ratios(spark, sf), features(spark, sf)
    p = B.engines(f, {"similarity": (FOUR, K), "final": (W, DEFAULT.k_final), "baseline": (None, K)}, vectors(spark, sf))
    p = p.unionByName(A.random_peers(f, K, DEFAULT.seed).withColumns({"sim": F.lit(0.0), "engine": F.lit("random")}))
    every = S.peer_cases(r, p, S.penalty(r), by=("engine",)).unionByName(S.market_cases(r).withColumns({"fail": F.lit(False), "engine": F.lit("market")}))
    return S.aggregate(every, "engine").select("engine", "ratio", "n", *r6(*_SCORES))


_PAIRED = f"""{PEERS}, {_BASEP}, {S.RATIOS_SQL}, {_cases_of('sim', 'peers')}, {_cases_of('base', 'bpeers')},
both_ AS (SELECT a.as_of, a.firm, a.ratio, a.ape AS x, c.ape AS y, @key AS key FROM cases_sim a JOIN cases_base c USING (as_of, firm, ratio)), """


def paired(spark: SparkSession, sf: str) -> DataFrame:
    """as_of, firm, ratio, x (error with the engine's peers), y (with the baseline's)."""
    r = ratios(spark, sf)
    c = S.peer_cases(r, B.engines(features(spark, sf), {"x": (FOUR, K), "y": (None, K)}), S.penalty(r), by=("engine",))
    return c.groupBy("as_of", "firm", "ratio").agg(*[F.max(F.when(F.col("engine") == e, F.col("ape"))).alias(e) for e in ("x", "y")])


def _bootstrap(name: str, key_sql: str, key) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        i = resample.interval(paired(spark, sf).withColumn("key", key()), DEFAULT.replicates)
        return i.select("replicates", "n", *r6("difference", "low", "mid", "high"), "better")

    run.__name__ = name
    query(_PAIRED.replace("@key", key_sql) + resample.interval_sql("both_", DEFAULT.replicates))(run)


_bootstrap("bootstrap_paired", "concat_ws('|', as_of::VARCHAR, firm::VARCHAR, ratio)", lambda: F.concat_ws("|", F.col("as_of").cast("string"), F.col("firm").cast("string"), F.col("ratio")))
_bootstrap("bootstrap_clustered", "firm::VARCHAR", lambda: F.col("firm").cast("string"))
