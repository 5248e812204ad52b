"""Reports on firms that someone asks for by name, from parameters that the dev snapshots decided once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.config import DEFAULT
from peerlens.operators import axes as A
from peerlens.operators import score as S
from peerlens.operators import single
from peerlens.sources.contexts import stamp
from peerlens.sources.snapshots import stored

from .audit_queries import MARKETS, lookup, universe
from .panel import read, snapshot
from .peer_queries import _BLOCK, _COH, _TAU, FINAL, _LABELLED, W, cohesion_bounds, final_peers, ratios, vectors
from .registry import query
from .text_queries import _FLOOR, _PAIRS, text_floor, text_pairs

_SPECS: dict[tuple[str, ...], dict] = {}
_TABLES = ("lineitem", "part", "supplier", "nation", "documents")


def serving_spec(spark: SparkSession, sf: str) -> dict:
    """What a report needs of the dev snapshots: weights, k, bounds of cohesion and deviation, thresholds of ill-conditioned ratios, floor of the text label. A few numbers, found once for a state of the tables."""
    key = (spark.sparkContext.applicationId, sf, stamp(spark, [f"{sf}/{t}.parquet" for t in _TABLES]))
    if key not in _SPECS:
        _SPECS.clear()
        dev = lambda d: d.where(F.col("as_of").isin(*DEFAULT.dev_years))
        r, p = ratios(spark, sf), stored(final_peers(spark, sf, DEFAULT.dev_years).drop(*W))  # used twice
        c, d = cohesion_bounds(S.cohesion(p)).first(), S.ratio_block(dev(r), p).agg(F.percentile("deviation", F.lit(0.9))).first()
        tau = {x.ratio: x.tau for x in S.ill_thresholds(r).collect()}  # one row for each ratio
        _SPECS[key] = {"weights": dict(W), "k": DEFAULT.k_final, "q33": c.q33, "q67": c.q67, "bound": d[0], "tau": tau, "floor": text_floor(text_pairs(spark, sf, DEFAULT.dev_years)).first()[0]}
    return _SPECS[key]


def firm_reports(spark: SparkSession, sf: str, names: list[str], year: int, spec: dict) -> DataFrame:
    """asked, status, and the nested report (operators.single) of each name that is one rankable firm, as of a snapshot. Only that snapshot's lines are read, and only the targets are ranked."""
    found = lookup(spark, universe(spark, sf), names).select("asked", "status", "firm")
    one = found.where("status = 'ok'").select("firm").distinct().collect()  # no more than there are names
    targets = spark.createDataFrame([(year, r.firm) for r in one], "as_of int, firm bigint")
    p = snapshot(spark, sf, year)
    f = A.features(p)
    peers = single.rank_targets(f, targets, spec["weights"], spec["k"], vectors(spark, sf) if "text" in spec["weights"] else None, max(single.MOST, len(names)))
    out = single.reports(p, peers, spec)
    labels = F.create_map(*[F.lit(x) for kv in MARKETS.items() for x in kv])
    out = out.withColumn("market", F.coalesce(labels[F.left("code", F.lit(2))], F.lit("other"))).withColumn("fiscal_year", F.col("as_of") - 1)
    j = found.join(F.broadcast(out), "firm", "left")  # a row for each target
    return j.withColumn("status", F.when((F.col("status") == "ok") & F.col("as_of").isNull(), "not_rankable").otherwise(F.col("status")))


def export_reports(reports: DataFrame, path: str) -> None:
    """One JSON file for each firm that has a report, in a folder of its own name under the path."""
    body = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    reports.where("status = 'ok'").select(F.col("firm").alias("corp"), body.alias("value")).dropDuplicates(["corp"]).write.mode("overwrite").partitionBy("corp").text(path)


_ASKED = ["Supplier#000000001", " supplier #000000002 ", "SUPPLIER#000000007", "Customer#000000003", "nobody"]
_YEAR = max(DEFAULT.snapshot_years)
_VALUES = ", ".join(f"('{n}')" for n in _ASKED)
_MICRO = "coalesce(round({0} * 1e6)::BIGINT::VARCHAR, '-')"


@query(f"""{FINAL}, {S.RATIOS_SQL}, {S.PEER_VALUES_SQL}, {_COH}, {_BLOCK}, {_TAU}, {_PAIRS}, {_FLOOR},
u AS (SELECT s_suppkey AS firm, s_name AS name, true AS rankable FROM supplier UNION ALL SELECT c_custkey, c_name, false FROM customer),
nk AS (SELECT *, lower(trim(replace(name, ' ', ''))) AS k FROM u), q AS (SELECT asked, lower(trim(replace(asked, ' ', ''))) AS k FROM (VALUES {_VALUES}) v(asked)),
e AS (SELECT asked, count(nk.firm) AS n, count(nk.firm) FILTER (WHERE rankable) AS usable, min(nk.firm) FILTER (WHERE rankable) AS firm FROM q LEFT JOIN nk ON q.k = nk.k GROUP BY asked),
lab AS (SELECT firm, rank, peer, sim, list_filter(list_transform(list_reverse_sort(list_filter([{_LABELLED}], lambda x: x.v > 0))[1:2], lambda x: x.l), lambda l: l <> 'text' OR text >= floor) AS l FROM peers CROSS JOIN fl WHERE as_of = {_YEAR}),
pr AS (SELECT firm, count(*) AS n_peers, string_agg(rank || ':' || peer || ':' || {_MICRO.format('sim')} || ':' || array_to_string(l, '+'), ';' ORDER BY rank) AS peers FROM lab GROUP BY firm),
rb AS (SELECT d.firm, ratio, d.n, peer_median, deviation, coalesce(deviation >= bound, false) AS chk, CASE WHEN ill THEN 'LOW' WHEN cohesion >= q67 THEN 'HIGH' WHEN cohesion >= q33 THEN 'MEDIUM' ELSE 'LOW' END AS sure,
  CASE WHEN peer_median IS NOT NULL THEN CASE WHEN actual > peer_median THEN 'above' ELSE 'below' END ELSE '-' END AS direction,
  CASE WHEN peer_median IS NULL THEN 'too few comparable peers' WHEN ill THEN 'small numerator' WHEN deviation >= bound THEN 'far from peers' ELSE '' END AS note
  FROM dev d CROSS JOIN dth CROSS JOIN th JOIN coh USING (as_of, firm) JOIN flags USING (as_of, firm, ratio) WHERE as_of = {_YEAR}),
rr AS (SELECT firm, string_agg(ratio || ':' || n || ':' || {_MICRO.format('peer_median')} || ':' || {_MICRO.format('deviation')} || ':' || direction || ':' || sure || ':' || note, ';' ORDER BY ratio) AS ratios,
  coalesce(string_agg(ratio, ',' ORDER BY ratio) FILTER (WHERE chk), '') AS flagged FROM rb GROUP BY firm)
SELECT asked, CASE WHEN usable = 1 AND x.firm IS NOT NULL THEN 'ok' WHEN usable > 1 THEN 'ambiguous' WHEN n > 0 THEN 'not_rankable' ELSE 'not_found' END AS status, x.firm, x.name, x.as_of - 1 AS fiscal_year, x.rcept_dt::VARCHAR AS rcept_dt,
  CASE left(x.code, 2) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MARKETS.items())} ELSE CASE WHEN x.firm IS NOT NULL THEN 'other' END END AS market,
  round(cohesion, 6) AS cohesion, CASE WHEN cohesion >= q67 THEN 'HIGH' WHEN cohesion >= q33 THEN 'MEDIUM' WHEN x.firm IS NOT NULL THEN 'LOW' END AS confidence, n_peers, peers, coalesce(ratios, CASE WHEN x.firm IS NOT NULL THEN '' END) AS ratios, coalesce(flagged, CASE WHEN x.firm IS NOT NULL THEN '' END) AS flagged
FROM e LEFT JOIN panel x ON x.firm = e.firm AND x.as_of = {_YEAR} AND e.usable = 1 LEFT JOIN coh ON coh.firm = x.firm AND coh.as_of = x.as_of CROSS JOIN th LEFT JOIN pr ON pr.firm = x.firm LEFT JOIN rr ON rr.firm = x.firm""")
def firm_report(spark: SparkSession, sf: str) -> DataFrame:
    """The reports on five names, as text: peers with rank, similarity (millionths) and labels, ratios beside the peers' medians, flags."""
    d = firm_reports(spark, sf, _ASKED, _YEAR, serving_spec(spark, sf))
    micro = lambda c: F.coalesce(F.round(c * 1e6).cast("bigint").cast("string"), F.lit("-"))
    peer = lambda x: F.concat_ws(":", x["rank"].cast("string"), x["peer"].cast("string"), micro(x["sim"]), F.array_join(x["top_axes"], "+"))
    ratio = lambda x: F.concat_ws(":", x["ratio"], x["n"].cast("string"), micro(x["peer_median"]), micro(x["deviation"]), F.coalesce(x["direction"], F.lit("-")), x["confidence"], x["note"])
    return d.select(
        "asked", "status", F.when(F.col("as_of").isNotNull(), F.col("firm")).alias("firm"), "name", "fiscal_year", F.col("rcept_dt").cast("string").alias("rcept_dt"), F.when(F.col("as_of").isNotNull(), F.col("market")).alias("market"),
        F.round("cohesion", 6).alias("cohesion"), "confidence", "n_peers", F.array_join(F.transform("peers", peer), ";").alias("peers"), F.array_join(F.transform("ratios", ratio), ";").alias("ratios"), F.array_join("flagged", ",").alias("flagged"))


__all__ = ["export_reports", "firm_report", "firm_reports", "read", "serving_spec"]
