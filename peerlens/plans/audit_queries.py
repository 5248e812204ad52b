"""Serving, audits and governance as queries: firms by name, reports, verdicts on mappings, caches, manifests, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.config import DEFAULT
from peerlens.functions import scalar as C
from peerlens.operators import govern as G
from peerlens.operators import hashtree as H
from peerlens.operators import statements as T
from peerlens.operators.qgrams import either_way, holding
from peerlens.sources import snapshots

from .data_queries import _WHOLE_SQL, whole_values
from .panel import PANEL_SQL, accounts, filings, firms, growth, lines, panel, read, segments
from .peer_queries import FINAL, final_peers, ratio_block
from .registry import ORACLE, query

_NAMES = ["Supplier#000000001", " supplier #000000002 ", "Supplier#00000000", "customer#000000003", "nobody", "", "SUPPLIER#000000004"]
_ASKED = ", ".join(f"('{n}')" for n in _NAMES)


@query(f"""WITH u AS (SELECT s_suppkey AS firm, s_name AS name, true AS rankable FROM supplier UNION ALL SELECT c_custkey, c_name, false FROM customer),
k AS (SELECT *, lower(trim(replace(name, ' ', ''))) AS k FROM u), q AS (SELECT name AS asked, lower(trim(replace(name, ' ', ''))) AS k FROM (VALUES {_ASKED}) v(name)),
e AS (SELECT q.asked, q.k, count(k.firm) AS exact, count(k.firm) FILTER (WHERE rankable) AS usable, min(k.firm) FILTER (WHERE rankable) AS firm FROM q LEFT JOIN k ON q.k = k.k GROUP BY ALL),
s AS (SELECT q.asked, count(*) AS n_similar FROM q JOIN k ON q.k <> '' AND q.k <> k.k AND contains(k.k, q.k) GROUP BY 1)
SELECT e.asked, CASE WHEN e.k = '' THEN 'empty' WHEN usable = 1 THEN 'ok' WHEN usable > 1 THEN 'ambiguous' WHEN exact > 0 THEN 'not_rankable' ELSE 'not_found' END AS status,
  CASE WHEN usable = 1 THEN firm END AS firm, coalesce(n_similar, 0) AS n_similar FROM e LEFT JOIN s USING (asked)""")
def firm_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of names that someone asks for: one rankable firm, several, only firms that can't be ranked, none (with how many names hold the words), or an empty name."""
    return lookup(spark, universe(spark, sf), _NAMES)


def universe(spark: SparkSession, sf: str) -> DataFrame:
    """firm, name, rankable: suppliers can be ranked, customers can't."""
    s, c = read(spark, sf, "supplier"), read(spark, sf, "customer")
    return s.select(F.col("s_suppkey").alias("firm"), F.col("s_name").alias("name"), F.lit(True).alias("rankable")).unionByName(c.select(F.col("c_custkey").alias("firm"), F.col("c_name").alias("name"), F.lit(False).alias("rankable")))


#: So many different names are held against each name of the universe; more are looked up by an index of q-grams.
ASKED_AT_ONCE = 100


def lookup(spark: SparkSession, universe: DataFrame, names: list[str], at_once: int = ASKED_AT_ONCE) -> DataFrame:
    """asked, status, firm, n_similar (names that hold the one asked for, but aren't it); universe: firm, name, rankable. A few names are sent to the universe, which is read where it
    lies and counted before anything is shuffled; for more, names that hold them are found on q-grams, and nothing that grows with the universe is broadcast."""
    u = universe.withColumn("k", C.name_key(F.col("name")))
    q = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "asked string").withColumn("k", C.name_key(F.col("asked")))
    e = u.join(q, "k").groupBy("asked").agg(F.count("*").alias("exact"), F.count_if("rankable").alias("usable"), F.min(F.when(F.col("rankable"), F.col("firm"))).alias("firm"))
    if len(set(names)) <= at_once:
        short = F.broadcast(q.where("k <> ''").select(F.col("k").alias("short")).distinct())  # no more than there are names
        n = u.join(short, (F.col("k") != F.col("short")) & F.contains("k", "short")).groupBy(F.col("short").alias("k")).agg(F.count("*").alias("n_similar"))
    else:
        held = holding(u.select(F.col("k").alias("s")), q.select(F.col("k").alias("s"))).where("long <> short").hint("shuffle_merge")
        n = held.join(u.groupBy(F.col("k").alias("long")).agg(F.count("*").alias("n")).hint("shuffle_merge"), "long").groupBy(F.col("short").alias("k")).agg(F.sum("n").alias("n_similar"))
    j = q.join(e, "asked", "left").join(n, "k", "left")
    status = F.when(F.col("k") == "", "empty").when(F.col("usable") == 1, "ok").when(F.col("usable") > 1, "ambiguous").when(F.col("exact") > 0, "not_rankable").otherwise("not_found")
    return j.select("asked", status.alias("status"), F.when(F.col("usable") == 1, F.col("firm")).alias("firm"), F.coalesce("n_similar", F.lit(0)).alias("n_similar"))


_WORDS = "w AS (SELECT DISTINCT lower(trim(replace(x, ' ', ''))) AS s FROM (SELECT p_name AS x FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT p_type || p_name FROM part UNION ALL SELECT left(p_type, 2) FROM part))"


@query(f"WITH {_WORDS} SELECT n.s AS name, q.s AS asked FROM w n JOIN w q ON n.s <> '' AND q.s <> '' AND (contains(n.s, q.s) OR contains(q.s, n.s))")
def names_either_way(spark: SparkSession, sf: str) -> DataFrame:
    """Which names of parts (whole, by word, with their type, and types by two letters) hold which, both ways, by an index of q-grams."""
    p = read(spark, sf, "part")
    each = F.concat(F.array("p_name"), F.split("p_name", " "), F.array(F.concat("p_type", "p_name"), F.left("p_type", F.lit(2))))
    w = p.select(F.explode(each).alias("x")).distinct().select(C.name_key(F.col("x")).alias("s"))
    return either_way(w, w)


MARKETS = {"00": "Africa", "01": "America", "02": "Asia", "03": "Europe", "04": "Middle East"}


@query(f"""WITH {PANEL_SQL} SELECT as_of, firm, name, code, as_of - 1 AS fiscal_year, rcept_dt::VARCHAR AS rcept_dt, CASE left(code, 2) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MARKETS.items())} ELSE 'other' END AS market FROM panel""")
def target_meta(spark: SparkSession, sf: str) -> DataFrame:
    """What a report says of its target: name, code, fiscal year, filing date, market by its label."""
    labels = F.create_map(*[F.lit(x) for kv in MARKETS.items() for x in kv])
    return panel(spark, sf).select("as_of", "firm", "name", "code", (F.col("as_of") - 1).alias("fiscal_year"), F.col("rcept_dt").cast("string").alias("rcept_dt"), F.coalesce(labels[F.left("code", F.lit(2))], F.lit("other")).alias("market"))


_KINDS = {"flagged": "flags > 0", "low_confidence": "low > 0", "all_comparable": "comparable = 4 AND flags = 0"}


@query(f"""WITH b AS ({ORACLE['ratio_block']}), r AS (SELECT as_of, firm, count(*) FILTER (WHERE needs_check) AS flags, count(*) FILTER (WHERE confidence = 'LOW') AS low, count(*) FILTER (WHERE comparable) AS comparable FROM b GROUP BY ALL),
k AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, min(as_of::BIGINT * 1000000000 + firm) AS x FROM r WHERE {c}" for k, c in _KINDS.items())})
SELECT kind, (x // 1000000000)::INT AS as_of, x % 1000000000 AS firm FROM k WHERE x IS NOT NULL""")
def report_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first report (by snapshot and firm) of each kind; all kinds in one aggregation."""
    r = ratio_block(spark, sf).groupBy("as_of", "firm").agg(F.count_if("needs_check").alias("flags"), F.count_if(F.col("confidence") == "LOW").alias("low"), F.count_if("comparable").alias("comparable"))
    g = r.agg(*[F.min(F.when(F.expr(c), F.struct("as_of", "firm"))).alias(k) for k, c in _KINDS.items()])
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("x")) for k in _KINDS])
    return g.select(F.explode(each).alias("e")).where("e.x is not null").select("e.kind", "e.x.as_of", "e.x.firm")


@query(f"{FINAL} SELECT as_of, firm, rank, peer, round(sim, 6) AS sim, max(rank) OVER () AS k, max(rank) OVER () = {DEFAULT.k_final} AS k_agrees FROM peers")
def selection_export(spark: SparkSession, sf: str) -> DataFrame:
    """The selection with similarities, and whether its label k is the largest rank."""
    p = snapshots.stored(final_peers(spark, sf))  # used twice
    k = F.broadcast(p.agg(F.max("rank").alias("k")))  # one row
    return p.crossJoin(k).select("as_of", "firm", "rank", "peer", F.round("sim", 6).alias("sim"), "k", (F.col("k") == DEFAULT.k_final).alias("k_agrees"))


@query(f"{FINAL} SELECT as_of, firm, array_to_string(list_sort(list(peer)), ',') AS members FROM peers GROUP BY ALL")
def peer_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The peers of each target as a set: what a median needs of them."""
    return final_peers(spark, sf).groupBy("as_of", "firm").agg(F.array_join(F.sort_array(F.collect_set("peer")), ",").alias("members"))


@query("""WITH e AS (SELECT o_custkey, month(max(o_orderdate)) AS m FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN left(c_mktsegment, 1) = 'M' THEN 'small_market' WHEN m <> 12 THEN 'other_year_end' ELSE 'other' END AS reason FROM customer LEFT JOIN e ON o_custkey = c_custkey""")
def no_report_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why a customer has no report: its market, or a year that ends in the month of its last order, which isn't December."""
    e = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.month(F.max("o_orderdate")).cast("string").alias("m"))
    c = read(spark, sf, "customer").join(e, "c_custkey", "left")
    return c.select("c_custkey", T.why_no_report(F.left("c_mktsegment", F.lit(1)), F.coalesce("m", F.lit("")), "M").alias("reason"))


@query("""SELECT corp, rcept_dt::VARCHAR AS rcept_dt, report FROM (SELECT o_custkey AS corp, o_orderdate::DATE AS rcept_dt, o_orderpriority || ' ' || o_orderstatus AS report,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderpriority || ' ' || o_orderstatus) AS n FROM orders WHERE contains(o_orderpriority || ' ' || o_orderstatus, 'U') AND NOT contains(o_orderpriority || ' ' || o_orderstatus, 'O')) WHERE n = 1""")
def first_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's first order whose description holds one word and not another."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("corp"), F.to_date("o_orderdate").alias("rcept_dt"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("report"))
    return T.first_report(o, "U", "O").select("corp", F.col("rcept_dt").cast("string").alias("rcept_dt"), "report")


_CACHE = """WITH w AS (SELECT c_custkey AS corp, y AS year FROM customer CROSS JOIN (SELECT unnest([1996, 1997, 1998]) AS y)),
o AS (SELECT o_custkey AS corp, year(o_orderdate)::INT AS year, count(*) AS size, bool_or(o_orderstatus = 'P') AS pending, bool_and(o_orderstatus = 'F') AS final FROM orders GROUP BY ALL),
k AS (SELECT corp, year, size FROM o WHERE final AND year < 1998), f AS (SELECT w.corp, w.year, CASE WHEN size IS NULL THEN '013' WHEN pending THEN '020' ELSE '000' END AS status, size FROM w LEFT JOIN o USING (corp, year))
"""


@query(f"{_CACHE} SELECT w.corp, w.year, CASE WHEN k.size IS NOT NULL THEN 'hit' ELSE CASE status WHEN '000' THEN 'miss_fetched' WHEN '013' THEN 'empty_cached' WHEN '020' THEN 'limit' ELSE 'error' END END AS outcome, CASE WHEN k.size IS NOT NULL THEN k.size WHEN status = '000' THEN f.size WHEN status = '013' THEN 0 END AS size FROM w LEFT JOIN k USING (corp, year) LEFT JOIN f USING (corp, year)")
def cache_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What comes of wanted statements: orders of a customer in a year are the statement, kept if all of them are final, out of reach while one is pending, and known not to exist where there are none."""
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("corp"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("size"), F.bool_or(F.col("o_orderstatus") == "P").alias("pending"), F.bool_and(F.col("o_orderstatus") == "F").alias("final"))
    w = read(spark, sf, "customer").select(F.col("c_custkey").alias("corp"), F.explode(F.array(*map(F.lit, (1996, 1997, 1998)))).alias("year"))
    status = F.when(F.col("size").isNull(), snapshots.NOTHING).when(F.col("pending"), snapshots.LIMIT).otherwise(snapshots.ROWS)
    f = w.join(o, ["corp", "year"], "left").withColumn("status", status)
    return snapshots.outcomes(w, o.where("final and year < 1998"), f, ["corp", "year"])


_SPACE = f"e AS (SELECT vec_id, CASE WHEN label < 2 THEN ({DEFAULT.snapshot_years[0]} + label)::INT END AS space FROM embeddings), y AS (SELECT unnest({list(DEFAULT.snapshot_years)})::INT AS year)"


@query(f"WITH {_SPACE}, u AS (SELECT year, CASE WHEN year IN (SELECT space FROM e WHERE space IS NOT NULL) THEN year END AS use FROM y) SELECT year, count(*) AS n, min(vec_id) AS first, max(use) IS NOT NULL AS own FROM u JOIN e ON e.space IS NOT DISTINCT FROM u.use GROUP BY year")
def vector_spaces(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that each snapshot uses: those of its own space, else the shared ones."""
    e = read(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") < 2, (F.lit(DEFAULT.snapshot_years[0]) + F.col("label")).cast("int")).alias("space"))
    v = snapshots.in_space(e, list(DEFAULT.snapshot_years))
    return v.groupBy("year").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("space").isNotNull().alias("own"))


@query(f"""WITH {PANEL_SQL}, n AS (SELECT firm, fy, round(sum(price * (1 - disc)), 4) AS revenue, round(sum(qty * p_retailprice), 4) AS cost FROM li JOIN part ON part = p_partkey WHERE flag <> 'R' GROUP BY firm, fy),
j AS (SELECT fy, a.revenue IS DISTINCT FROM n.revenue AS r, a.cost IS DISTINCT FROM n.cost AS c FROM acc a FULL JOIN n USING (firm, fy)),
l AS (SELECT fy, 'revenue' AS account, r AS d FROM j UNION ALL SELECT fy, 'cost', c FROM j) SELECT fy, account, count(*) FILTER (WHERE d) AS changed, count(*) FILTER (WHERE d) = 0 AS same FROM l GROUP BY ALL""")
def change_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each account a restatement without returned goods changes, by year, and whether the digests of both versions agree."""
    a = accounts(spark, sf).select("firm", "fy", "revenue", "cost")
    return G.manifest(a, restated(spark, sf), ["firm", "fy"], ["revenue", "cost"], "fy").select("fy", "account", "changed", "same")


_NEW = "n AS (SELECT firm, fy, round(sum(price * (1 - disc)), 4) AS revenue, round(sum(qty * p_retailprice), 4) AS cost FROM li JOIN part ON part = p_partkey WHERE flag <> 'R' GROUP BY firm, fy)"
_LINE = "firm::VARCHAR || '|' || fy::VARCHAR"


@query(f"""WITH {PANEL_SQL}, {_NEW}, {H.tree_sql('o', 'acc', _LINE, _WHOLE_SQL, 2)}, {H.tree_sql('w', 'n', _LINE, _WHOLE_SQL, 2)}
SELECT level, node, coalesce(o.n, 0) AS old_n, coalesce(w.n, 0) AS new_n FROM o FULL JOIN w USING (level, node) WHERE o.digest IS DISTINCT FROM w.digest""")
def changed_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The ranges of keys in which a restatement differs from the accounts before, from the root down to the leaves."""
    key = F.concat_ws("|", F.col("firm").cast("string"), F.col("fy").cast("string"))
    trees = [H.tree(d, key, whole_values(), 2) for d in (accounts(spark, sf), restated(spark, sf))]
    return H.differing(*trees)


def restated(spark: SparkSession, sf: str) -> DataFrame:
    """firm, fy, revenue, cost without the lines that were returned."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("retail"))
    kept = lines(spark, sf).where("flag <> 'R'").join(p, "part")
    return kept.groupBy("firm", "fy").agg(F.round(F.sum(F.col("price") * (1 - F.col("disc"))), 4).alias("revenue"), F.round(F.sum(F.col("qty") * F.col("retail")), 4).alias("cost"))


@query(f"WITH {PANEL_SQL} SELECT 'universe' AS phase, count(*) AS n FROM filings WHERE year IN {DEFAULT.snapshot_years} UNION ALL SELECT 'scale', count(*) FROM acc UNION ALL SELECT 'industry', count(*) FROM firms UNION ALL SELECT 'segment', count(*) FROM seg UNION ALL SELECT 'features', count(*) FROM panel")
def snapshot_phases(spark: SparkSession, sf: str) -> DataFrame:
    """Builds a version of the snapshots in five phases, each written before the next begins, publishes it, and counts the rows of its tables as readers see them."""
    store = snapshots.Versions(spark, snapshots.shared_folder(spark))
    phases = snapshot_builder(spark, sf)
    store.build("first", phases)
    store.publish("first", list(phases))
    out = None
    for name in phases:
        p = store.read(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("phase"), "n")
        out = p if out is None else out.unionByName(p)
    return out


def snapshot_builder(spark: SparkSession, sf: str, years: tuple[int, ...] = DEFAULT.snapshot_years) -> dict[str, snapshots.Phase]:
    """The phases of the snapshots of some years: who filed, accounts, codes and market values, segments, and the features, which are made from the four tables before."""

    def features(t: dict[str, DataFrame]) -> DataFrame:
        a = t["scale"].withColumn("year", F.col("fy") + 1)
        g, s = (d.withColumn("year", F.col("fy") + 1).drop("fy") for d in (growth(t["scale"]), t["segment"]))
        j = t["universe"].join(a.drop("fy"), ["firm", "year"]).join(g, ["firm", "year"], "left").join(s, ["firm", "year"], "left").join(t["industry"], "firm", "left")
        return j.withColumnRenamed("year", "as_of")

    return {
        "universe": lambda t: filings(spark, sf).where(F.col("year").isin(*years)), "scale": lambda t: accounts(spark, sf), "industry": lambda t: firms(spark, sf), "segment": lambda t: segments(spark, sf), "features": features,
    }
