"""Sources, sinks, streams and gates at work on the given tables: what was written is read again, and decisions rest on what is recomputed."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens.config import DEFAULT, RATIOS, SCALE_ACCOUNTS
from peerlens.functions import scalar as C
from peerlens.operators import documents as D
from peerlens.operators import govern as G
from peerlens.sources import snapshots, tables
from peerlens.streaming import filings as stream

from .filing_queries import _ROWS, NO_SECTION, filing_documents
from .panel import PANEL_SQL, filings, panel, read
from .peer_queries import FINAL, W, final_peers, labels
from .registry import ORACLE, query

_P = f"WITH {PANEL_SQL}"


@query(f"{_P} SELECT as_of, count(*) AS n, sum(trunc(revenue)::BIGINT)::BIGINT AS revenue, count(growth) AS n_growth FROM panel WHERE as_of IN (1998, 2000) GROUP BY as_of")
def layer_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """A layer written by snapshot, with amounts as whole numbers; two of its years are read again, and one that it doesn't have."""
    at = f"{snapshots.shared_folder(spark)}/scale"
    tables.write_layer(panel(spark, sf).select("as_of", "firm", "revenue", "growth"), at, ("revenue",))
    schema = T.StructType([T.StructField("firm", T.LongType()), T.StructField("revenue", T.LongType()), T.StructField("growth", T.DoubleType()), T.StructField("as_of", T.IntegerType())])
    d = tables.read_layer(spark, at, schema, 1998).unionByName(tables.read_layer(spark, at, schema, 2000)).unionByName(tables.read_layer(spark, at, schema, 1950)).unionByName(tables.read_layer(spark, f"{at}-none", schema))
    return d.groupBy("as_of").agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"), F.count("growth").alias("n_growth"))


@query("""SELECT c_custkey::VARCHAR AS corp_code, c_name AS corp_name, left(c_mktsegment, 1) AS corp_cls, CASE WHEN c_acctbal < 0 THEN '' ELSE lpad(c_custkey::VARCHAR, 6, '0') END AS stock_code, coalesce(strftime(max(o_orderdate), '%Y-%m-%d'), '') AS rcept_dt
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def ledger_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger written as CSV, with eight-digit dates and nulls, and read as text: dates dashed, nulls empty."""
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.date_format(F.max("o_orderdate"), "yyyyMMdd").alias("rcept_dt"))
    c = read(spark, sf, "customer").join(o, "c_custkey", "left")
    d = c.select(F.col("c_custkey").cast("string").alias("corp_code"), F.col("c_name").alias("corp_name"), F.left("c_mktsegment", F.lit(1)).alias("corp_cls"), F.when(F.col("c_acctbal") >= 0, F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("stock_code"), "rcept_dt", F.lit(None).cast("string").alias("report_nm"))
    at = f"{snapshots.shared_folder(spark)}/ledger"
    d.write.option("header", True).csv(at)
    return tables.read_ledger(spark, at).drop("report_nm")


_WHYS = ", ".join(f"round({x / sum(W.values())!r}::DOUBLE * {a}, 6) AS why_{a}" for a, x in W.items())


@query(f"{FINAL} SELECT firm, as_of, rank, peer, round(sim, 6) AS sim, {_WHYS} FROM peers")
def peer_report_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The peer report as a flat file with a column for each axis of the rationale, read again."""
    why = F.struct(*[F.round(F.lit(x / sum(W.values())) * F.col(a), 6).alias(a) for a, x in W.items()])
    one = F.struct("rank", "peer", F.round("sim", 6).alias("sim"), why.alias("why"))
    rep = labels(final_peers(spark, sf), W).groupBy("firm", "as_of").agg(F.lit("").alias("grade"), F.collect_list(one).alias("peers"))
    at = f"{snapshots.shared_folder(spark)}/report"
    tables.write_report_csv(rep, at)
    schema = f"firm bigint, as_of int, grade string, rank int, peer bigint, sim double, {', '.join(f'why_{a} double' for a in W)}"
    return spark.read.schema(schema).option("header", True).csv(at).drop("grade")


@query(ORACLE["market_medians"])
def rows_json(spark: SparkSession, sf: str) -> DataFrame:
    """A table of results as JSON lines, read again."""
    from .peer_queries import market_medians

    d, at = market_medians(spark, sf), f"{snapshots.shared_folder(spark)}/medians"
    tables.write_rows_json(d, at)
    return spark.read.schema(d.schema).json(at)


@query(f"WITH {_ROWS} SELECT corp AS doc_id, CASE WHEN region = '{NO_SECTION}' THEN 2 ELSE 3 END AS n_titles, CASE WHEN region = '{NO_SECTION}' THEN 'I. Company,III. Statement' ELSE 'I. Company,II. Segments,III. Statement' END AS titles FROM (SELECT DISTINCT corp, region FROM rws)")
def filing_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of the filings' top-level sections, in order."""
    d = D.sections(filing_documents(spark, sf).select("doc_id", "raw"))
    return d.select("doc_id", "n_titles", F.array_join(F.transform("sections", lambda s: s["title"]), ",").alias("titles"))


@query(f"WITH {_ROWS} SELECT corp AS doc_id, CASE WHEN fy < 1998 THEN 'hit' ELSE 'miss_fetched' END AS outcome, CASE WHEN region = '{NO_SECTION}' THEN 0 ELSE 1 END::BIGINT AS size FROM (SELECT DISTINCT corp, fy, region FROM rws)")
def section_cache(spark: SparkSession, sf: str) -> DataFrame:
    """What comes of wanted sections, those of early years being kept already: a section that a filing doesn't have is kept as an empty one."""
    docs = filing_documents(spark, sf)
    s = D.section(docs.select("doc_id", "raw"), "Segments").join(docs.select("doc_id", "fy"), "doc_id")
    s = s.select("doc_id", "fy", F.lit("ok").alias("status"), (F.col("status") == "ok").cast("bigint").alias("size"))
    return snapshots.section_outcomes(s.select("doc_id"), s.where("fy < 1998").select("doc_id", "size"), s.where("fy >= 1998"), ["doc_id"])


_OPS = ["<=", "<", ">=", ">", "=="]


@query(f"{_P} " + " UNION ALL ".join(f"SELECT '{op}' AS op, count(*) FILTER (WHERE growth {'=' if op == '==' else op} 0.1) AS n FROM panel" for op in _OPS))
def comparisons(spark: SparkSession, sf: str) -> DataFrame:
    """How many growth rates stand in each relation to a tenth; a missing one stands in none."""
    g = panel(spark, sf).agg(*[F.count_if(C.compare(op, F.col("growth"), F.lit(0.1))).alias(op) for op in _OPS])
    return g.select(F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"`{op}`").alias("n")) for op in _OPS])).alias("x")).select("x.op", "x.n")


_KEY, _TOKEN = b"query", "consent"


@query(f"""{_P}, m AS (SELECT avg((growth IS NOT NULL)::INT) AS cover, count(*) AS n, avg((growth IS NOT NULL)::INT) >= 0.5 AND count(*) >= 1 AS fine FROM panel)
SELECT gate, CASE gate WHEN 'honest' THEN CASE WHEN fine THEN 'passed' ELSE 'failed' END WHEN 'approved' THEN CASE WHEN fine THEN 'approved' ELSE 'failed' END WHEN 'amended' THEN 'waiting' ELSE 'failed' END AS state, round(cover, 6) AS cover
FROM m CROSS JOIN (SELECT unnest(['honest', 'misstated', 'forged', 'approved', 'amended']) AS gate)""")
def gate_states(spark: SparkSession, sf: str) -> DataFrame:
    """A gate on the panel's coverage: passed by recomputing, failed by a value that was misstated or a record whose seal doesn't fit, approved by a person, amended and waiting again."""
    metrics = {"cover": lambda t: t["panel"].agg(F.avg(F.col("growth").isNotNull().cast("double"))), "rows": lambda t: t["panel"].agg(F.count("*"))}
    t, checks = {"panel": panel(spark, sf)}, [G.Check("cover", "at_least", 0.5), G.Check("rows", "at_least", 1.0)]
    real = {k: v for k, v in G.recompute(t, metrics).items() if v is not None}
    gate = G.open_gate("coverage", checks, _KEY)
    decide = lambda g: G.decide(g, t, metrics, _KEY, "query")
    honest = decide(G.state_values(gate, real, _KEY))
    misstated = decide(G.state_values(gate, {**real, "cover": real.get("cover", 0.0) + 0.3}, _KEY))
    forged = decide(replace(G.state_values(gate, {**real, "cover": 0.0}, _KEY), stated=tuple(sorted(real.items()))))
    tokens = {"auditor": G.hashlib.sha256(_TOKEN.encode()).hexdigest()}
    approved = G.approve(honest, "auditor", _TOKEN, tokens, _KEY) if honest.state == G.PASSED else honest
    amended = G.amend(honest, [G.Check("cover", "at_least", 0.9)], "a higher bound", _KEY)
    states = {"honest": honest, "misstated": misstated, "forged": forged, "approved": approved, "amended": amended}
    return spark.createDataFrame([(k, g.state) for k, g in states.items()], "gate string, state string").crossJoin(t["panel"].agg(F.round(F.avg(F.col("growth").isNotNull().cast("double")), 6).alias("cover")))  # one row


@query(f"{_P} SELECT metric, NOT moves AS constant FROM (SELECT 'rows' AS metric, (SELECT count(*) FROM panel) <> (SELECT count(*) FROM panel WHERE as_of > 1997) AS moves UNION ALL SELECT 'snapshots', (SELECT count(DISTINCT as_of) FROM panel) <> (SELECT count(DISTINCT as_of) FROM panel WHERE as_of > 1997) UNION ALL SELECT 'always', false)")
def constant_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Which metrics stay the same when snapshots are taken away: such a check says nothing."""
    t = {"panel": panel(spark, sf)}
    metrics = {"rows": lambda x: x["panel"].agg(F.count("*")), "snapshots": lambda x: x["panel"].agg(F.count_distinct("as_of")), "always": lambda x: x["panel"].agg(F.max(F.lit(1)))}
    found = [(k, G.never_moves(m, t, {"panel": lambda d: d.where("as_of > 1997")})) for k, m in metrics.items()]
    return spark.createDataFrame(found, "metric string, constant boolean")


_SIDES = ", ".join(f"('{r.name}', '{r.numerator}', '{r.denominator}')" for r in RATIOS)
_SEEN = ", ".join(f"'{a}'" for a in SCALE_ACCOUNTS)


@query(f"""{_P}, s(ratio, num, den) AS (VALUES {_SIDES}), c AS (SELECT column_name AS account FROM (DESCRIBE SELECT * FROM panel)),
k AS (SELECT 'engine' AS what, ratio FROM s WHERE num IN ({_SEEN}) AND den IN ({_SEEN}) UNION ALL SELECT 'panel', ratio FROM s WHERE num IN (SELECT account FROM c) AND den IN (SELECT account FROM c))
SELECT what, ratio, (SELECT count(*) FROM panel WHERE as_of IN {DEFAULT.dev_years}) AS n FROM k""")
def leaking_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios both of whose sides could be seen: none by what the engine may read, all by the panel's columns."""
    p, specs = panel(spark, sf), [(r.name, r.numerator, r.denominator) for r in RATIOS]
    each = [G.shared_sides(spark, specs, seen).select(F.lit(what).alias("what"), "ratio") for what, seen in (("engine", list(SCALE_ACCOUNTS)), ("panel", p.columns))]
    return each[0].unionByName(each[1]).crossJoin(p.where(F.col("as_of").isin(*DEFAULT.dev_years)).agg(F.count("*").alias("n")))  # one row


@query(f"{_P} SELECT firm, max(rcept_dt)::VARCHAR AS rcept_dt, count(*) AS n FROM filings GROUP BY firm")
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest filing of each firm, from filings that arrive as files of a stream; all that are there are worked off."""
    at = snapshots.shared_folder(spark)
    filings(spark, sf).select("firm", F.col("rcept_dt").cast("timestamp").alias("rcept_dt")).repartition(4, "firm").write.parquet(f"{at}/in")
    source = spark.readStream.schema("firm bigint, rcept_dt timestamp").option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    run = stream.latest(source).writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
    run.foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("firm", F.to_date("rcept_dt").cast("string").alias("rcept_dt"), "n")


