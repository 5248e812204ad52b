"""Filings made from the lines: every firm and fiscal year has a statement and a segment table, in the words of its region, as rows and as a document in markup.

What is read from the documents again is held against the lines themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.functions import scalar as C
from peerlens.operators import documents as D
from peerlens.operators import statements as T

from .panel import PANEL_SQL, accounts, firms, lines, read
from .registry import ORACLE, query

#: Lines of a region's statements: region, place, statement, name, concept id, account. "both" are receivables and inventory together.
STATEMENT = [
    ("00", 0, "BS", "Trade and other receivables", "x_TradeAndOtherReceivables", "both"), ("00", 1, "BS", "Trade receivables", "x_TradeReceivables", "receivables"), ("00", 2, "BS", "Inventories", "x_Inventories", "inventory"),
    ("00", 3, "IS", "Revenue", "x_Revenue", "revenue"), ("00", 4, "IS", "Cost of sales", "x_CostOfSales", "cost"), ("00", 5, "IS", "Operating income", "-", "op_income"),
    ("01", 0, "BS", "Trade receivables (net)", "-", "receivables"), ("01", 1, "BS", "Inventories", "-", "inventory"), ("01", 2, "IS", "Sales", "-", "revenue"), ("01", 3, "IS", "Operating expenses", "-", "cost"), ("01", 4, "IS", "Operating income", "-", "op_income"),
    ("02", 0, "BS", "Trade and other receivables", "x_TradeAndOtherReceivables", "both"), ("02", 1, "IS", "Revenue", "x_Revenue", "revenue"), ("02", 2, "IS", "Cost of sales", "x_CostOfSales", "cost"), ("02", 3, "IS", "Operating income", "-", "op_income"),
    ("03", 0, "BS", "Trade receivables", "-", "receivables"), ("03", 1, "IS", "Turnover (net)", "-", "revenue"), ("03", 2, "IS", "Operating expenses", "x_OperatingExpenses", "cost"), ("03", 3, "IS", "Cost of sales", "x_CostOfSales", "cost"),
    ("04", 0, "BS", "Other receivables", "x_OtherReceivables", "both"), ("04", 1, "BS", "Inventories", "-", "inventory"), ("04", 2, "IS", "Net sales", "-", "revenue"), ("04", 3, "IS", "Operating income", "-", "op_income"),
]
ALIASES = {
    "receivables": {"aliases": ["Trade receivables", "Trade and other receivables"], "statements": ["BS"]}, "revenue": {"aliases": ["Revenue", "Sales", "Turnover"], "statements": ["IS"]},
    "cost": {"aliases": ["Operating expenses", "Cost of sales"], "statements": ["IS"]},
}
#: Words that a candidate's name has, one of the first and none of the second; all in one statement.
KEYWORDS = {"receivables": (["receivable"], [], "BS"), "revenue": (["Revenue", "Sales", "sales", "Turnover"], ["Cost"], "IS"), "cost": (["Cost", "xpenses"], [], "IS")}
#: Filings of these regions have no section on segments, or one whose table doesn't name the shares.
NO_SECTION, NO_SHARES = "04", "02"


def statement_rows(spark: SparkSession, sf: str) -> DataFrame:
    """corp (firm and fiscal year in one number), firm, fy, region, pos, sj_div, account, name, id, value (whole units), amount (as filings write it)."""
    a = accounts(spark, sf).withColumn("both", F.col("receivables") + F.col("inventory")).join(firms(spark, sf).select("firm", F.left("code", F.lit(2)).alias("region")), "firm")
    long = a.unpivot(["firm", "fy", "region"], ["revenue", "cost", "op_income", "receivables", "inventory", "both"], "account", "v")
    form = spark.createDataFrame(STATEMENT, "region string, pos int, sj_div string, name string, id string, account string")
    r = long.join(F.broadcast(form), ["region", "account"]).withColumn("value", F.round("v", 0).cast("bigint"))  # the form is a constant
    text = F.format_number(F.abs("value"), 0)
    amount = F.when(F.col("value") > 0, text).when(F.col("value") < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise("-")
    return r.select((F.col("firm") * 10_000 + F.col("fy")).alias("corp"), "firm", "fy", "region", "pos", "sj_div", "account", "name", "id", "value", amount.alias("amount"))


def filing_documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id (corp), raw: the filing in markup, with the company, its segments and its statement as sections."""
    cells = lambda *c: F.concat(F.lit("<TR>"), *[F.concat(F.lit("<TD>"), x, F.lit("</TD>")) for x in c], F.lit("</TR>"))
    rows = statement_rows(spark, sf)
    s = rows.groupBy("corp", "firm", "fy", "region").agg(F.sort_array(F.collect_list(F.struct("pos", cells(F.col("name"), F.col("amount")).alias("row")))).alias("r"))
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("segment"))
    by = lines(spark, sf).join(p, "part").groupBy("firm", "fy", "segment").agg(F.round(F.sum(F.col("price") * (1 - F.col("disc"))), 4).alias("v"))
    by = by.groupBy("firm", "fy").agg(F.sort_array(F.collect_list(F.struct("segment", F.round("v", 0).cast("bigint").alias("v")))).alias("g"), F.sum(F.round("v", 0).cast("bigint")).alias("total"))
    d = s.join(by, ["firm", "fy"]).join(firms(spark, sf).select("firm", "name"), "firm")
    join = lambda a, f: F.array_join(F.transform(a, f), "")
    head = F.when(F.col("region") == NO_SHARES, cells(F.lit("Segment"), F.lit("Revenue"))).otherwise(cells(F.lit("Segment"), F.lit("Revenue"), F.lit("Share")))
    segments = F.concat(F.lit("<TITLE>II. Segments</TITLE><TABLE>"), head, join("g", lambda x: cells(x["segment"], F.format_number(x["v"], 0))), cells(F.lit("Total"), F.format_number("total", 0)), F.lit("</TABLE>"))
    raw = F.concat(
        F.lit("<TITLE>I. Company</TITLE><P>"), "name", F.lit("</P>"), F.when(F.col("region") == NO_SECTION, "").otherwise(segments),
        F.lit("<TITLE>III. Statement</TITLE><TABLE>"), join("r", lambda x: x["row"]), F.lit("</TABLE>"))
    return d.select(F.col("corp").alias("doc_id"), "firm", "fy", "region", raw.alias("raw"))


_FORM = ", ".join(f"('{r}', {p}, '{d}', '{n}', '{i}', '{a}')" for r, p, d, n, i, a in STATEMENT)
_ALIAS = ", ".join(f"('{a}', '{x.replace(' ', '')}', {i}, '{s['statements'][0]}')" for a, s in ALIASES.items() for i, x in enumerate(s["aliases"]))
_ROWS = f"""{PANEL_SQL}, form(region, pos, div, name, id, account) AS (VALUES {_FORM}), al(account, alias, priority, div) AS (VALUES {_ALIAS}),
wide AS (SELECT firm, fy, left(code, 2) AS region, revenue, cost, op_income, receivables, inventory, receivables + inventory AS "both" FROM acc JOIN firms USING (firm)),
rws AS (SELECT firm * 10000 + fy AS corp, firm, fy, l.region, pos, div, form.account, name, id, round(v)::BIGINT AS value FROM (UNPIVOT wide ON revenue, cost, op_income, receivables, inventory, "both" INTO NAME account VALUE v) l JOIN form ON form.region = l.region AND form.account = l.account),
res AS (SELECT * FROM (SELECT r.corp, al.account, r.pos, r.value, row_number() OVER (PARTITION BY r.corp, al.account ORDER BY priority, r.pos) AS n FROM rws r JOIN al ON r.div = al.div AND (replace(r.name, ' ', '') = alias OR regexp_replace(replace(r.name, ' ', ''), '\\([^()]*\\)$', '') = alias) WHERE r.value > 0) WHERE n = 1)"""


def resolved(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return T.resolve_rows(rows, T.alias_table(spark, ALIASES))


@query(f"WITH {_ROWS} SELECT corp, account, value AS amount FROM res")
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Each account by the first of its aliases that has a readable line in the right statement of a filing."""
    return resolved(spark, statement_rows(spark, sf)).select("corp", "account", "amount")


_CAND = " UNION ALL ".join(f"SELECT corp, '{a}' AS account, pos, name, id FROM rws WHERE div = '{d}' AND ({' OR '.join(f'''contains(replace(name, ' ', ''), '{w}')''' for w in inc)})" + "".join(f" AND NOT contains(replace(name, ' ', ''), '{w}')" for w in exc) for a, (inc, exc, d) in KEYWORDS.items())


@query(f"""WITH {_ROWS}, cand AS ({_CAND}),
t AS (SELECT c.*, res.pos IS NOT NULL AS chosen, CASE WHEN id = '-' THEN '' ELSE regexp_replace(lower(id), '[^a-z]', '', 'g') END AS c, replace(name, ' ', '') AS n FROM cand c LEFT JOIN res ON res.corp = c.corp AND res.account = c.account AND res.pos = c.pos),
u AS (SELECT *, CASE WHEN c <> '' THEN contains(c, 'tradereceivable') ELSE n = 'Tradereceivables' OR n = 'Tradereceivables(net)' END AS trade, contains(c, 'tradeandother') OR contains(n, 'andother') AS summed, contains(c, 'costofsales') OR n = 'Costofsales' AS direct,
  contains(c, 'revenue') AS standard, contains(n, 'evenue') OR contains(n, 'ales') AS usual FROM t),
g AS (SELECT corp, account, count(*) AS n, bool_or(chosen) AS chosen, coalesce(bool_or(trade) FILTER (WHERE chosen), false) AS trade, coalesce(bool_or(summed) FILTER (WHERE chosen), false) AS summed, coalesce(bool_or(trade) FILTER (WHERE NOT chosen), false) AS trade2,
  coalesce(bool_or(direct) FILTER (WHERE chosen), false) AS direct, coalesce(bool_or(direct) FILTER (WHERE NOT chosen), false) AS direct2, coalesce(bool_or(standard OR usual) FILTER (WHERE chosen), false) AS plain FROM u GROUP BY ALL),
e AS (SELECT c.corp, a.account, coalesce(g.n, 0) AS n, coalesce(chosen, false) AS chosen, trade, summed, trade2, direct, direct2, plain FROM (SELECT DISTINCT corp FROM rws) c CROSS JOIN (SELECT unnest({list(KEYWORDS)}) AS account) a LEFT JOIN g ON g.corp = c.corp AND g.account = a.account)
SELECT corp, account, n AS candidates, CASE WHEN NOT chosen THEN CASE WHEN n > 0 THEN 'NO_PICK' ELSE 'NA' END
  WHEN account = 'receivables' THEN CASE WHEN trade THEN 'OK' WHEN summed THEN CASE WHEN trade2 THEN 'APPROX' ELSE 'DISCLOSURE' END ELSE 'OK' END
  WHEN account = 'cost' THEN CASE WHEN direct THEN 'OK' WHEN direct2 THEN 'MISMAP' ELSE 'DEFINITIONAL' END ELSE CASE WHEN plain THEN 'OK' ELSE 'MISMAP' END END AS verdict FROM e""")
def mapping_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on the lines that were chosen for three accounts, beside all candidates that keywords find in the same statement."""
    r = statement_rows(spark, sf)
    search = [F.when((F.col("sj_div") == d) & T.names_one_of(F.col("name"), inc, exc), F.lit(a)) for a, (inc, exc, d) in KEYWORDS.items()]
    c = r.select("corp", "pos", "name", C.concept_id(F.col("id")).alias("c"), F.explode(F.array_compact(F.array(*search))).alias("account"))
    c = c.join(resolved(spark, r).select("corp", "account", "pos", F.lit(True).alias("picked")), ["corp", "account", "pos"], "left")
    name = F.col("name")
    c = c.withColumns({
        "chosen": F.coalesce("picked", F.lit(False)), "trade": T.is_trade_only(F.col("c"), name, ["Tradereceivables", "Tradereceivables(net)"]), "summed": T.is_summed(F.col("c"), name, ["andother"]),
        "direct": F.contains("c", F.lit("costofsales")) | (F.regexp_replace(name, " ", "") == "Costofsales"), "standard": F.contains("c", F.lit("revenue")), "usual": T.names_one_of(name, ["evenue", "ales"], [])})
    on = lambda x, w: F.coalesce(F.bool_or(F.when(F.col("chosen") == w, F.col(x))), F.lit(False))
    g = c.groupBy("corp", "account").agg(F.count("*").alias("n"), F.bool_or("chosen").alias("chosen"), *[on(x, True).alias(x) for x in ("trade", "summed", "direct", "standard", "usual")], on("trade", False).alias("trade2"), on("direct", False).alias("direct2"))
    every = r.select("corp").distinct().withColumn("account", F.explode(F.array(*map(F.lit, KEYWORDS)))).join(g, ["corp", "account"], "left")
    n, chosen = F.coalesce("n", F.lit(0)), F.coalesce("chosen", F.lit(False))
    verdict = F.when(F.col("account") == "receivables", T.receivable_choice(n, chosen, F.col("trade"), F.col("summed"), F.col("trade2"))).when(F.col("account") == "cost", T.cost_choice(n, chosen, F.col("direct"), F.col("direct2")))
    return every.select("corp", "account", n.alias("candidates"), verdict.otherwise(T.plain_choice(n, chosen, F.col("standard"), F.col("usual"))).alias("verdict"))


_VERDICTS = ["OK", "MISMAP", "APPROX", "DEFINITIONAL", "DISCLOSURE", "NO_PICK", "NA"]


@query(f"""SELECT account, {', '.join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v.lower()}" for v in _VERDICTS)}, round(100.0 * count(*) FILTER (WHERE verdict = 'MISMAP') / nullif(count(*) FILTER (WHERE verdict <> 'NA'), 0), 6) AS rate FROM ({ORACLE['mapping_classes']}) GROUP BY account""")
def mapping_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Account by verdict, counted in one pivot, with the share of wrong ones among those that there is anything to judge of."""
    g = mapping_classes(spark, sf).groupBy("account").pivot("verdict", _VERDICTS).count().na.fill(0)
    total = sum((F.col(v) for v in _VERDICTS[1:-1]), F.col("OK"))
    return g.select("account", *[F.col(v).alias(v.lower()) for v in _VERDICTS], F.round(100.0 * F.col("MISMAP") / F.nullif(total, F.lit(0)), 6).alias("rate"))


@query(f"""WITH {_ROWS}, s AS (SELECT firm, fy, round(v)::BIGINT AS v FROM segv WHERE round(v) >= 1000),
t AS (SELECT firm, fy, sum(v)::DOUBLE AS total FROM s GROUP BY ALL), g AS (SELECT firm, fy, count(*) AS n, max(v / total) AS top, sum((v / total) * (v / total)) AS q FROM s JOIN t USING (firm, fy) GROUP BY ALL), f AS (SELECT DISTINCT corp, firm, fy, region FROM rws)
SELECT corp AS doc_id, CASE WHEN region = '{NO_SECTION}' THEN 'no_section' WHEN region = '{NO_SHARES}' THEN 'no_table' WHEN n IS NULL THEN 'no_rows' ELSE 'ok' END AS status,
  CASE WHEN region NOT IN ('{NO_SECTION}', '{NO_SHARES}') THEN n END AS seg_n, CASE WHEN region NOT IN ('{NO_SECTION}', '{NO_SHARES}') THEN round(top, 6) END AS seg_top_share,
  CASE WHEN region NOT IN ('{NO_SECTION}', '{NO_SHARES}') THEN round(q, 6) END AS seg_hhi FROM f LEFT JOIN g USING (firm, fy)""")
def segment_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Concentration of segments, read from the filings' tables: sections by title, tables by their words, amounts by their look."""
    d = D.segment_profile(filing_documents(spark, sf).select("doc_id", "raw"), "Segments", ["Revenue"], ["Share"], ["Total"])
    return d.select("doc_id", "status", F.col("seg_n").cast("bigint").alias("seg_n"), "seg_top_share", "seg_hhi")


_NAMES = sorted({x for s in ALIASES.values() for x in s["aliases"]} | {"Inventories", "Net sales", "Operating income"})


@query(f"""WITH {_ROWS} SELECT f.corp AS doc_id, coalesce(string_agg(DISTINCT regexp_replace(r.name, ' \\([^()]*\\)$', ''), ',' ORDER BY regexp_replace(r.name, ' \\([^()]*\\)$', '')), '') AS found
FROM (SELECT DISTINCT corp FROM rws) f LEFT JOIN rws r ON r.corp = f.corp AND abs(r.value) >= 1000 AND list_contains({_NAMES}, regexp_replace(r.name, ' \\([^()]*\\)$', '')) GROUP BY f.corp""")
def account_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Which accounts a filing's tables have, by label and an amount that looks like money."""
    bare = {n.replace(" ", ""): n for n in _NAMES}
    d = D.accounts_found(filing_documents(spark, sf).select("doc_id", "raw"), list(bare))
    names = F.create_map(*[F.lit(x) for kv in bare.items() for x in kv])
    return d.select("doc_id", F.array_join(F.array_sort(F.transform("found", lambda x: names[x])), ",").alias("found"))


_USUAL, _MORE = ["Tradereceivables"], ["Tradeandotherreceivables"]


@query(f"""WITH {_ROWS}, k AS (SELECT corp, any_value(region) AS region, bool_or(abs(value) >= 1000 AND name IN ('Trade receivables', 'Trade receivables (net)')) AS usual, bool_or(abs(value) >= 1000 AND name = 'Trade and other receivables') AS more,
  bool_or(name IN ('Trade receivables', 'Trade receivables (net)', 'Trade and other receivables')) AS named FROM rws GROUP BY corp)
SELECT corp AS doc_id, CASE WHEN more THEN 'wording' WHEN NOT named THEN 'absent' ELSE 'outside_tables' END AS reason FROM k WHERE NOT usual""")
def not_found_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why a filing's receivables aren't found by their usual name: other words, no mention at all, no tables or hardly any text, or a mention without an amount."""
    docs = filing_documents(spark, sf).select("doc_id", "raw")
    f = D.accounts_found(docs, [*_USUAL, *_MORE]).join(docs.select("doc_id", F.size(F.flatten(D.table_rows(F.col("raw")))).alias("rows"), F.length(C.flat_text(F.col("raw"))).alias("size")), "doc_id")
    has = lambda c, names: F.arrays_overlap(c, F.array(*map(F.lit, names)))
    f = f.where(~has(F.col("found"), _USUAL))
    return f.select("doc_id", T.why_not_found(has(F.col("found"), _MORE), F.size("mentioned") > 0, F.col("rows"), F.col("size"), 100).alias("reason"))


@query(f"WITH {_ROWS} SELECT account, name, count(*) AS n, count(*) FILTER (WHERE abs(value) >= 1000) AS matched, round(avg((abs(value) < 1000)::INT) * 100, 6) AS mismatch_pct FROM rws GROUP BY account, name")
def value_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Stored values against those that are read from the filings again, by account and by the label that was found there; null-safe."""
    stored = statement_rows(spark, sf).select("corp", "account", "name", "value")
    amounts = D.labelled_amounts(F.flatten(D.table_rows(F.col("raw"))))
    again = filing_documents(spark, sf).select(F.col("doc_id").alias("corp"), F.explode(amounts).alias("x")).select("corp", F.col("x.label").alias("name"), F.get("x.amounts", F.lit(0)).alias("again"))
    same = F.col("value").cast("double").eqNullSafe(F.col("again"))
    j = stored.join(again, ["corp", "name"], "left")
    return j.groupBy("account", "name").agg(F.count("*").alias("n"), F.count_if(same).alias("matched"), F.round(F.avg((~same).cast("int")) * 100, 6).alias("mismatch_pct"))


@query(f"WITH {_ROWS} SELECT corp, pos, CASE WHEN value > 0 THEN value END AS amount FROM rws")
def parse_amount(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts as filings write them, as numbers: with commas, in parentheses (no number here), or missing."""
    return statement_rows(spark, sf).select("corp", "pos", C.parse_amount(F.col("amount")).alias("amount"))
