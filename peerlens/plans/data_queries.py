"""Snapshots, look-ups, presence, audits, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.config import DEFAULT, RATIOS, SCALE_ACCOUNTS, SCORED_ACCOUNTS
from peerlens.functions import scalar as C
from peerlens.operators import hashtree as H
from peerlens.operators import relational as R
from peerlens.operators import score as S

from .panel import PANEL_SQL, accounts, filings, firms, growth, lines, panel, read, segments
from .registry import ORACLE, query

DAYS = [f"{y}-05-15" for y in DEFAULT.snapshot_years]
_DAYS = "(VALUES " + ", ".join(f"(DATE '{d}')" for d in DAYS) + ") AS s(snap)"
_P = f"WITH {PANEL_SQL}"
_DAY = "make_date({0}, 5, 15)"


def day_of(year: str) -> Column:
    return F.make_date(F.col(year), F.lit(5), F.lit(15))


def customer_years(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("corp"), F.year("o_orderdate").alias("year")).distinct()


_CY = "cy AS (SELECT DISTINCT o_custkey AS corp, year(o_orderdate)::INT AS year FROM orders)"


@query(f"SELECT d::VARCHAR AS day, max(snap)::VARCHAR AS snapshot FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) LEFT JOIN {_DAYS} ON snap <= d GROUP BY d")
def asof_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select(F.col("d").cast("string").alias("day"), R.as_of_date(F.col("d"), DAYS).cast("string").alias("snapshot"))


@query("""SELECT o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders) o ASOF LEFT JOIN (
  SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts""")
def asof_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each order with the last event of its customer before it."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    e = read(spark, sf, "events").groupBy("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).agg(F.max("event_id").alias("event_id"))
    return R.as_of_join(o, e, "user_id", "at", "ts", ["event_id"]).select("o_orderkey", "event_id")


@query(f"{_P} SELECT fy AS year, count(*) AS n, count(DISTINCT firm) AS firms FROM li WHERE day <= {_DAY.format('fy')} GROUP BY fy")
def pit_filter(spark: SparkSession, sf: str) -> DataFrame:
    return R.known_at(lines(spark, sf), day_of("fy"), "day").groupBy(F.col("fy").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("firm").alias("firms"))


@query(f"{_P} SELECT fy AS year, firm, count(*) AS n FROM li WHERE day > {_DAY.format('fy')} GROUP BY ALL")
def pit_violations(spark: SparkSession, sf: str) -> DataFrame:
    return R.violations(lines(spark, sf), day_of("fy"), "day").groupBy(F.col("fy").alias("year"), "firm").agg(F.count("*").alias("n"))


_LAYERS = "SELECT DISTINCT fy + 1 AS y, 'scale' AS layer FROM acc UNION SELECT DISTINCT year, 'universe' FROM filings UNION SELECT DISTINCT fy + 1, 'growth' FROM growth WHERE growth IS NOT NULL UNION SELECT DISTINCT f.year, 'industry' FROM filings f JOIN firms USING (firm) WHERE code IS NOT NULL UNION SELECT DISTINCT f.year, 'mktcap' FROM filings f JOIN firms USING (firm) WHERE mktcap IS NOT NULL UNION SELECT DISTINCT fy + 1, 'ratios' FROM acc WHERE revenue > 0"


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    a = accounts(spark, sf)
    parts = {
        "scale": a.select((F.col("fy") + 1).alias("y")), "universe": filings(spark, sf).select(F.col("year").alias("y")), "growth": growth(a).where("growth is not null").select((F.col("fy") + 1).alias("y")), "industry": filings(spark, sf).join(firms(spark, sf).where("code is not null").select("firm"), "firm", "left_semi").select(F.col("year").alias("y")),
        "mktcap": filings(spark, sf).join(firms(spark, sf).where("mktcap is not null").select("firm"), "firm", "left_semi").select(F.col("year").alias("y")), "ratios": a.where("revenue > 0").select((F.col("fy") + 1).alias("y"))}
    out = None
    for name, p in parts.items():
        p = p.distinct().withColumn("layer", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


@query(f"{_P} SELECT y AS year FROM ({_LAYERS}) GROUP BY y HAVING count(DISTINCT layer) = 6")
def snapshot_years_complete(spark: SparkSession, sf: str) -> DataFrame:
    return _layers(spark, sf).groupBy(F.col("y").alias("year")).agg(F.count_distinct("layer").alias("n")).where("n = 6").select("year")


@query(f"{_P} SELECT max(y) AS year FROM (SELECT y FROM ({_LAYERS}) GROUP BY y HAVING count(DISTINCT layer) = 6)")
def serving_year(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot to serve without a pin: the latest complete one."""
    return snapshot_years_complete(spark, sf).agg(F.max("year").alias("year"))


@query("""WITH o AS (SELECT o_custkey AS code, o_orderdate::DATE AS d, o_totalprice AS v FROM orders), l AS (SELECT snap, max(d) AS last_day FROM o JOIN """ + _DAYS + """ ON d <= snap GROUP BY snap)
SELECT snap::VARCHAR AS as_of, last_day::VARCHAR AS last_day, lpad(code::VARCHAR, 6, '0') AS code, round(sum(v), 2) AS cap FROM l JOIN o ON d = last_day GROUP BY ALL""")
def asof_mktcap(spark: SparkSession, sf: str) -> DataFrame:
    """Values on the market's last day not after each snapshot; the day is common to all codes. The days are a few rows."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("code"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    days = o.select("d").distinct().select("d", F.explode(F.array(*[F.to_date(F.lit(s)) for s in DAYS])).alias("snap")).where("d <= snap").groupBy("snap").agg(F.max("d").alias("d"))
    j = o.join(F.broadcast(days), "d")  # one row for each snapshot
    return j.groupBy(F.col("snap").cast("string").alias("as_of"), F.col("d").cast("string").alias("last_day"), C.zero_pad(F.col("code"), 6).alias("code")).agg(F.round(F.sum("v"), 2).alias("cap"))


@query(f"{_P} SELECT firm, fy, round(growth, 6) AS growth FROM growth")
def revenue_growth(spark: SparkSession, sf: str) -> DataFrame:
    return growth(accounts(spark, sf)).select("firm", "fy", F.round("growth", 6).alias("growth"))


@query(f"{_P} SELECT firm, fy, seg_n, round(seg_top, 6) AS seg_top, seg_hhi FROM seg")
def segment_profile(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).select("firm", "fy", "seg_n", F.round("seg_top", 6).alias("seg_top"), "seg_hhi")


@query(f"{_P}, one AS (SELECT firm, arg_max(seg_hhi, fy) AS hhi FROM seg GROUP BY firm) SELECT f.year, f.firm, hhi FROM filings f LEFT JOIN one ON one.firm = f.firm WHERE f.year IN {DEFAULT.dev_years}")
def segment_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """A firm's one profile, sent to each dev year that it filed in."""
    one = R.latest(segments(spark, sf), "firm", "fy", "seg_hhi").withColumnRenamed("seg_hhi", "hhi")
    return filings(spark, sf).where(F.col("year").isin(*DEFAULT.dev_years)).join(one, "firm", "left").select("year", "firm", "hhi")


@query(f"{_P} SELECT firm, year, rcept_dt::VARCHAR AS rcept_dt FROM filings")
def earliest_filing(spark: SparkSession, sf: str) -> DataFrame:
    return filings(spark, sf).select("firm", "year", F.col("rcept_dt").cast("string").alias("rcept_dt"))


@query(f"{_P} SELECT firm, snap::VARCHAR AS as_of, max(day)::VARCHAR AS rcept_dt FROM li JOIN {_DAYS} ON day <= snap GROUP BY ALL")
def latest_filing(spark: SparkSession, sf: str) -> DataFrame:
    """The latest filing of a firm not after each snapshot: the last one of each span between snapshots, then a running maximum over a firm's few spans."""
    li = lines(spark, sf)
    span = F.array_min(F.filter(F.array(*[F.to_date(F.lit(s)) for s in DAYS]), lambda s: s >= F.col("day")))
    per = li.select("firm", "day", span.alias("snap")).where("snap is not null").groupBy("firm", "snap").agg(F.max("day").alias("d"))
    every = per.groupBy("firm").agg(F.collect_list(F.struct("snap", "d")).alias("x")).select("firm", "x", F.explode(F.array(*[F.to_date(F.lit(s)) for s in DAYS])).alias("snap"))
    best = F.array_max(F.transform(F.filter("x", lambda v: v["snap"] <= F.col("snap")), lambda v: v["d"]))
    return every.select("firm", F.col("snap").cast("string").alias("as_of"), best.cast("string").alias("rcept_dt")).where("rcept_dt is not null")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS n FROM orders) WHERE n = 1""")
def source_preference(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each key, by preference of its kind."""
    kind = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return R.first_row(read(spark, sf, "orders"), ["o_custkey"], kind, F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_row_wins(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(read(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT user_id FROM events)""")
def resume_todo(spark: SparkSession, sf: str) -> DataFrame:
    """What is wanted and listed, but not there yet."""
    c = read(spark, sf, "customer").select("c_custkey")
    c = c.join(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return c.join(read(spark, sf, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT DISTINCT year(l_shipdate)::INT AS year FROM lineitem")
def partition_years(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select(F.col("fy").alias("year")).distinct()


@query(f"WITH {_CY} SELECT corp, min(year) AS first, max(year) AS last, count(*) AS years FROM cy GROUP BY corp")
def presence_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.presence(customer_years(spark, sf), "corp", "year")


@query(f"WITH {_CY}, s AS (SELECT year, count(*) AS size FROM cy GROUP BY year) SELECT year, size, size - lag(size) OVER (ORDER BY year) AS step FROM s")
def universe_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes by year and their steps: the sizes of the year before, by equality."""
    s = customer_years(spark, sf).groupBy("year").agg(F.count("*").alias("size"))
    before = s.select((F.col("year") + 1).alias("year"), F.col("size").alias("b"))
    return s.join(before, "year", "left").select("year", "size", (F.col("size") - F.col("b")).alias("step"))


@query(f"""WITH {_CY}, y AS (SELECT unnest(range((SELECT min(year) FROM cy) + 1, (SELECT max(year) FROM cy)))::INT AS t),
g AS (SELECT t, c.corp FROM y CROSS JOIN (SELECT DISTINCT corp FROM cy) c WHERE EXISTS (SELECT 1 FROM cy WHERE cy.corp = c.corp AND cy.year < t)
  AND NOT EXISTS (SELECT 1 FROM cy WHERE cy.corp = c.corp AND cy.year = t) AND EXISTS (SELECT 1 FROM cy WHERE cy.corp = c.corp AND cy.year IN (t + 1, t + 2)))
SELECT t AS year, (SELECT count(*) FROM g WHERE g.t = y.t) AS absent, (SELECT count(*) FROM cy WHERE year = y.t) AS total,
  round(100.0 * (SELECT count(*) FROM g WHERE g.t = y.t) / (SELECT count(*) FROM cy WHERE year = y.t), 6) AS pct FROM y""")
def missing_survivor(spark: SparkSession, sf: str) -> DataFrame:
    return R.missing_survivors(customer_years(spark, sf), "corp", "year")


@query(f"SELECT count(*) AS years, round(avg(pct), 5) AS mean_pct, max(pct) AS worst_pct FROM ({ORACLE['missing_survivor']})")
def missing_survivor_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The share of missing survivors, averaged over the years."""
    m = missing_survivor(spark, sf)
    return m.agg(F.count("*").alias("years"), F.round(F.avg("pct"), 5).alias("mean_pct"), F.max("pct").alias("worst_pct"))


@query(f"""WITH {_CY}, m AS (SELECT max(year) AS top FROM cy), f AS (SELECT corp, bool_or(year = top) AS last1, bool_or(year = top - 1) AS last2 FROM cy CROSS JOIN m GROUP BY corp)
SELECT corp, CASE WHEN last1 THEN 'survived' WHEN last2 THEN 'recent_gap' ELSE 'departed' END AS class FROM f""")
def departed_class(spark: SparkSession, sf: str) -> DataFrame:
    c = customer_years(spark, sf)
    top = c.agg(F.max("year").alias("top"))
    f = c.crossJoin(F.broadcast(top)).groupBy("corp").agg(F.bool_or(F.col("year") == F.col("top")).alias("a"), F.bool_or(F.col("year") == F.col("top") - 1).alias("b"))  # one row
    return f.select("corp", F.when(F.col("a"), "survived").when(F.col("b"), "recent_gap").otherwise("departed").alias("class"))


@query(f"""WITH {_CY}, d AS (SELECT corp FROM cy GROUP BY corp HAVING max(year) <= (SELECT max(year) - 2 FROM cy)) SELECT count(*) AS departed, count(l.corp) AS retained FROM d LEFT JOIN (SELECT corp FROM cy WHERE year = (SELECT max(year) FROM cy)) l ON l.corp = d.corp""")
def dead_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Firms absent in the last two years that are in the last year all the same: always 0, kept as the example of a metric that can't fail."""
    c = departed_class(spark, sf).where("class = 'departed'").select("corp")
    last = customer_years(spark, sf).groupBy("corp").agg(F.max("year").alias("y"))
    top = last.agg(F.max("y").alias("top"))
    alive = last.crossJoin(F.broadcast(top)).where("y = top").select("corp", F.lit(1).alias("in_last"))  # one row
    return c.join(alive, "corp", "left").agg(F.count("*").alias("departed"), F.count("in_last").alias("retained"))


@query(f"""WITH {_CY}, gap AS (SELECT corp FROM cy GROUP BY corp HAVING max(year) - min(year) + 1 > count(*)), k AS (SELECT coalesce(c_mktsegment, 'NA') AS k, count(*) AS n FROM gap JOIN customer ON corp = c_custkey GROUP BY 1)
SELECT arg_max(k, (n, k)) AS top, round(100.0 * max(n) / sum(n), 6) AS pct FROM k""")
def top1_concentration(spark: SparkSession, sf: str) -> DataFrame:
    gap = R.presence(customer_years(spark, sf), "corp", "year").where("last - first + 1 > years").select("corp")
    k = gap.join(read(spark, sf, "customer").select(F.col("c_custkey").alias("corp"), F.coalesce("c_mktsegment", F.lit("NA")).alias("k")), "corp").groupBy("k").agg(F.count("*").alias("n"))
    return k.agg(F.max_by("k", F.struct("n", "k")).alias("top"), F.round(100.0 * F.max("n") / F.sum("n"), 6).alias("pct"))


@query(f"""WITH {_CY}, p AS (SELECT corp, min(year) AS a, max(year) AS b FROM cy GROUP BY corp), x AS (SELECT min(year) AS lo, max(year) AS hi FROM cy)
SELECT CASE WHEN a = lo AND b = hi THEN 'control' WHEN a > lo AND b = hi THEN 'entered' WHEN a = lo THEN 'dropped_out' ELSE 'passing' END AS kind, count(*) AS n FROM p CROSS JOIN x GROUP BY 1""")
def membership_kinds(spark: SparkSession, sf: str) -> DataFrame:
    p = R.presence(customer_years(spark, sf), "corp", "year")
    x = p.crossJoin(F.broadcast(p.agg(F.min("first").alias("lo"), F.max("last").alias("hi"))))  # one row
    kind = F.when((F.col("first") == F.col("lo")) & (F.col("last") == F.col("hi")), "control").when((F.col("first") > F.col("lo")) & (F.col("last") == F.col("hi")), "entered").when(F.col("first") == F.col("lo"), "dropped_out").otherwise("passing")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {_CY} SELECT corp, year FROM cy WHERE year = 1996 UNION SELECT corp, year FROM cy WHERE year = 1997")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    c = customer_years(spark, sf)
    return c.where("year = 1996").union(c.where("year = 1997")).distinct()


@query(f"WITH {_CY} SELECT corp FROM cy WHERE year = 1996 INTERSECT SELECT corp FROM cy WHERE year = 1998")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    c = customer_years(spark, sf)
    return c.where("year = 1996").select("corp").intersect(c.where("year = 1998").select("corp"))


@query(f"WITH {_CY} SELECT corp FROM cy WHERE year = 1996 EXCEPT SELECT corp FROM cy WHERE year = 1998")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    c = customer_years(spark, sf)
    return c.where("year = 1996").select("corp").exceptAll(c.where("year = 1998").select("corp"))


@query(f"""{_P}, y AS (SELECT as_of, as_of IN {DEFAULT.dev_years} AS dev, count(*) AS n FROM panel GROUP BY as_of)
SELECT count(*) FILTER (WHERE dev) AS dev_snapshots, count(*) FILTER (WHERE NOT dev) AS holdout_snapshots, sum(n) FILTER (WHERE dev)::BIGINT AS dev_rows, sum(n) FILTER (WHERE NOT dev)::BIGINT AS holdout_rows,
  (SELECT count(*) FROM (SELECT as_of FROM y WHERE dev INTERSECT SELECT as_of FROM y WHERE NOT dev)) AS shared FROM y""")
def split_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """The panel's snapshots and rows on either side of the split, and how many snapshots are on both."""
    y = panel(spark, sf).groupBy("as_of", F.col("as_of").isin(*DEFAULT.dev_years).alias("dev")).agg(F.count("*").alias("n"))
    both = y.where("dev").select("as_of").intersect(y.where("not dev").select("as_of")).agg(F.count("*").alias("shared"))
    on = lambda c, f: f(F.when(c, F.col("n")))
    d = F.col("dev")
    return y.agg(on(d, F.count).alias("dev_snapshots"), on(~d, F.count).alias("holdout_snapshots"), on(d, F.sum).alias("dev_rows"), on(~d, F.sum).alias("holdout_rows")).crossJoin(both)  # one row each


@query(f"{_P} SELECT count(*) AS outside FROM panel p WHERE NOT EXISTS (SELECT 1 FROM filings f WHERE f.firm = p.firm AND f.year = p.as_of)")
def features_in_universe(spark: SparkSession, sf: str) -> DataFrame:
    f = filings(spark, sf).select("firm", F.col("year").alias("as_of"))
    return panel(spark, sf).join(f, ["firm", "as_of"], "left_anti").agg(F.count("*").alias("outside"))


@query(f"WITH {_CY} SELECT 'entered' AS kind, corp, min(year)::VARCHAR AS first_year, NULL::VARCHAR AS last_year FROM cy GROUP BY corp HAVING min(year) > 1995 UNION ALL SELECT 'left', corp, NULL, max(year)::VARCHAR FROM cy GROUP BY corp HAVING max(year) < 2001")
def tagged_append(spark: SparkSession, sf: str) -> DataFrame:
    p = R.presence(customer_years(spark, sf), "corp", "year")
    a = p.where("first > 1995").select(F.lit("entered").alias("kind"), "corp", F.col("first").cast("string").alias("first_year"))
    b = p.where("last < 2001").select(F.lit("left").alias("kind"), "corp", F.col("last").cast("string").alias("last_year"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""WITH c AS (SELECT lower(trim(replace(c_name, ' ', ''))) AS k, list_sort(list(c_custkey)) AS codes FROM customer GROUP BY 1) SELECT k, len(codes) AS n, array_to_string(codes, ',') AS codes,
  CASE WHEN len(codes) > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM c""")
def name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised name -> codes; a name of several firms is ambiguous."""
    c = read(spark, sf, "customer").groupBy(C.name_key(F.col("c_name")).alias("k")).agg(F.sort_array(F.collect_list("c_custkey")).alias("codes"))
    return c.select("k", F.size("codes").alias("n"), F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), F.when(F.size("codes") > 1, "ambiguous").otherwise("ok").alias("status"))


_Q = "customer#000000012"


@query(f"""WITH c AS (SELECT c_name AS name, min(c_custkey) AS code, bool_or(c_acctbal > 0) AS rankable FROM customer GROUP BY 1), m AS (SELECT *, lower(trim(replace(name, ' ', ''))) AS k FROM c)
SELECT name, code, k <> '{_Q}' AS inexact, rankable FROM m WHERE contains(k, '{_Q}') OR contains('{_Q}', k) ORDER BY k <> '{_Q}', NOT rankable, length(name), name LIMIT 8""")
def name_suggest(spark: SparkSession, sf: str) -> DataFrame:
    """Names that hold the query or are held by it: exact ones first, then rankable, then short ones; one entry for a name."""
    c = read(spark, sf, "customer").groupBy(F.col("c_name").alias("name")).agg(F.min("c_custkey").alias("code"), F.bool_or(F.col("c_acctbal") > 0).alias("rankable"))
    m = c.withColumn("k", C.name_key(F.col("name"))).where(F.col("k").contains(_Q) | F.lit(_Q).contains(F.col("k"))).withColumn("inexact", F.col("k") != _Q)
    return m.orderBy("inexact", ~F.col("rankable"), F.length("name"), "name").limit(8).select("name", "code", "inexact", "rankable")


_R = f"{_P}, {S.RATIOS_SQL}"


@query(f"""{_R}, d AS (SELECT r.*, left(code, 2) AS g FROM ratios r JOIN firms USING (firm) WHERE value IS NOT NULL), a AS (SELECT as_of, ratio, g, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM d GROUP BY ALL)
SELECT as_of, ratio, sum(n)::BIGINT AS n, count(*) AS groups, round(CASE WHEN sum(n) >= 3 AND count(*) >= 2 AND sum(q) - sum(s) * sum(s) / sum(n) > 0 THEN (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(q) - sum(s) * sum(s) / sum(n)) END, 6) AS eta2 FROM a GROUP BY ALL""")
def eta_squared(spark: SparkSession, sf: str) -> DataFrame:
    d = S.ratio_table(panel(spark, sf)).join(firms(spark, sf).select("firm", F.left("code", F.lit(2)).alias("g")), "firm")
    return R.eta_squared(d, "g", "value", ["as_of", "ratio"]).withColumn("eta2", F.round("eta2", 6))


@query(f"""{_P}, c AS (SELECT code, count(*) AS n FROM firms GROUP BY code), b AS (SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END AS bucket, sum(n)::BIGINT AS firms FROM c GROUP BY 1)
SELECT bucket, firms, round(100.0 * firms / sum(firms) OVER (), 1) AS pct FROM b""")
def code_size_buckets(spark: SparkSession, sf: str) -> DataFrame:
    c = firms(spark, sf).groupBy("code").agg(F.count("*").alias("n")).groupBy(R.bucket_of(F.col("n")).alias("bucket")).agg(F.sum("n").alias("firms"))
    return c.withColumn("pct", F.expr("round(100.0D * firms / sum(firms) over (partition by 1), 1)"))  # four rows


@query(f"""{_R}, i AS (SELECT left(code, 2) AS g, ratio, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM ratios JOIN firms USING (firm) GROUP BY ALL) SELECT g, round(avg(iqr), 6) AS iqr FROM i GROUP BY g""")
def within_group_iqr(spark: SparkSession, sf: str) -> DataFrame:
    d = S.ratio_table(panel(spark, sf)).join(firms(spark, sf).select("firm", F.left("code", F.lit(2)).alias("g")), "firm")
    i = d.groupBy("g", "ratio").agg((F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("iqr"))
    return i.groupBy("g").agg(F.round(F.avg("iqr"), 6).alias("iqr"))


@query(f"{_P}, c AS (SELECT as_of, corr(ln(mktcap), ln(revenue)) AS c FROM panel WHERE mktcap > 0 AND revenue > 0 GROUP BY as_of) SELECT count(*) AS years, round(avg(c), 6) AS mean_corr FROM c")
def log_corr(spark: SparkSession, sf: str) -> DataFrame:
    c = panel(spark, sf).where("mktcap > 0 and revenue > 0").groupBy("as_of").agg(F.corr(F.ln("mktcap"), F.ln("revenue")).alias("c"))
    return c.agg(F.count("*").alias("years"), F.round(F.avg("c"), 6).alias("mean_corr"))


@query(f"{_P} SELECT as_of, count(*) AS n, round(avg((mktcap > 0)::INT), 6) AS cap_cover, round(avg((growth IS NOT NULL)::INT), 6) AS growth_cover FROM panel GROUP BY as_of")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf).groupBy("as_of").agg(F.count("*").alias("n"), F.round(F.avg((F.col("mktcap") > 0).cast("int")), 6).alias("cap_cover"), F.round(F.avg(F.col("growth").isNotNull().cast("int")), 6).alias("growth_cover"))


@query("SELECT o_custkey AS corp, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS label FROM orders GROUP BY 1")
def latest_value(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("corp")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("label"))


@query(f"""{_P}, o AS (SELECT a.firm, a.fy, f.rcept_dt, a.revenue, a.cost FROM acc a JOIN filings f ON f.firm = a.firm AND f.year = a.fy),
n AS (SELECT firm, fy, CASE WHEN firm % 3 = 0 THEN rcept_dt + 1 ELSE rcept_dt END AS d, revenue + (firm % 2) AS revenue, CASE WHEN firm % 4 = 0 THEN NULL ELSE cost END AS cost FROM o),
j AS (SELECT o.*, n.revenue AS r2, n.cost AS c2, coalesce(n.d = o.rcept_dt AND n.d <= make_date(o.fy, 5, 15), false) AS ok FROM o LEFT JOIN n ON n.firm = o.firm AND n.fy = o.fy)
SELECT firm, fy, CASE WHEN ok THEN r2 ELSE revenue END AS revenue, CASE WHEN ok THEN c2 ELSE cost END AS cost,
  concat_ws(',', CASE WHEN ok AND coalesce(r2, 0) <> coalesce(revenue, 0) THEN 'revenue' END, CASE WHEN ok AND coalesce(c2, 0) <> coalesce(cost, 0) THEN 'cost' END) AS changed FROM j""")
def keep_old_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = accounts(spark, sf).join(filings(spark, sf).withColumnRenamed("year", "fy"), ["firm", "fy"]).select("firm", "fy", "rcept_dt", "revenue", "cost")
    n = o.select("firm", "fy", F.when(F.col("firm") % 3 == 0, F.date_add("rcept_dt", 1)).otherwise(F.col("rcept_dt")).alias("rcept_dt"), (F.col("revenue") + F.col("firm") % 2).alias("revenue"), F.when(F.col("firm") % 4 != 0, F.col("cost")).alias("cost"))
    return R.keep_old(o, n, ["firm", "fy"], ["revenue", "cost"], "rcept_dt", day_of("fy")).drop("rcept_dt")


_WHOLE_SQL = "(revenue * 10000)::DECIMAL(38, 0)::VARCHAR || '|' || (cost * 10000)::DECIMAL(38, 0)::VARCHAR"


def whole_values() -> Column:
    """Revenue and cost as text, in ten-thousandths."""
    whole = lambda c: F.round(F.col(c) * 10000, 0).cast("decimal(38,0)").cast("string")
    return F.concat_ws("|", whole("revenue"), whole("cost"))


@query(f"{_P}, {H.tree_sql('t', 'acc', 'firm::VARCHAR', _WHOLE_SQL, 2, 'fy')} SELECT fy, digest FROM t WHERE level = 0")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of each year's accounts: the root of a tree over ranges of firms."""
    return H.root(accounts(spark, sf), F.col("firm").cast("string"), whole_values(), 2, ["fy"])


@query(f"{_P} SELECT firm, fy, account, round(v, 4) AS v FROM (UNPIVOT (SELECT firm, fy, revenue, cost, gross, op_income, inventory, receivables FROM acc) ON revenue, cost, gross, op_income, inventory, receivables INTO NAME account VALUE v)")
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    return accounts(spark, sf).unpivot(["firm", "fy"], list(SCORED_ACCOUNTS), "account", "v").where("v is not null")


@query(f"{_P} SELECT count(*) AS n FROM acc WHERE coalesce(revenue, cost, gross, op_income, inventory, receivables) IS NOT NULL")
def any_account(spark: SparkSession, sf: str) -> DataFrame:
    return accounts(spark, sf).where(F.coalesce(*SCORED_ACCOUNTS).isNotNull()).agg(F.count("*").alias("n"))


_NEED = sorted({a for r in RATIOS for a in (r.numerator, r.denominator)})


_ALL_NEEDED = [*_NEED, *[a for a in SCALE_ACCOUNTS if a not in _NEED]]


@query(f"""{_P}, l AS (UNPIVOT (SELECT firm, fy, {', '.join(_ALL_NEEDED)} FROM acc) ON {', '.join(_ALL_NEEDED)} INTO NAME account VALUE v)
SELECT account, account NOT IN ({', '.join(f"'{a}'" for a in _NEED)}) AS feature_only, count(*) AS n, count(*) FILTER (WHERE v <> 0) AS n_nonzero FROM l GROUP BY account""")
def required_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts that the ratios need, and those that only features need, with how many values the filings have of each."""
    need = {a for r in RATIOS for a in (r.numerator, r.denominator)}
    every = sorted(need | set(SCALE_ACCOUNTS))
    long = accounts(spark, sf).unpivot(["firm", "fy"], every, "account", "v").where("v is not null")
    return long.groupBy("account").agg((~F.col("account").isin(sorted(need))).alias("feature_only"), F.count("*").alias("n"), F.count_if(F.col("v") != 0).alias("n_nonzero"))


@query(f"{_P}, d AS (SELECT firm, fy, list_filter([{', '.join(f"CASE WHEN {r.numerator} IS NOT NULL AND {r.denominator} > 0 THEN '{r.name}' END" for r in RATIOS)}], lambda x: x IS NOT NULL) AS d FROM acc) SELECT firm, fy, len(d) AS n, array_to_string(d, ',') AS defined FROM d")
def defined_ratios(spark: SparkSession, sf: str) -> DataFrame:
    d = F.array_compact(F.array(*[F.when(F.col(r.numerator).isNotNull() & (F.col(r.denominator) > 0), F.lit(r.name)) for r in RATIOS]))
    return accounts(spark, sf).select("firm", "fy", F.size(d).alias("n"), F.array_join(d, ",").alias("defined"))


@query("SELECT c_custkey, lpad(c_custkey::VARCHAR, 6, '0') AS code, regexp_matches(lpad(c_custkey::VARCHAR, 6, '0'), '^[0-9]{6}$') AS listed, ends_with(c_custkey::VARCHAR, '0') AS common, lpad(c_nationkey::VARCHAR, 2, '0') IN ('03', '07') AS excluded FROM customer")
def code_predicates(spark: SparkSession, sf: str) -> DataFrame:
    code = C.zero_pad(F.col("c_custkey").cast("string"), 6)
    return read(spark, sf, "customer").select("c_custkey", code.alias("code"), C.is_listed(code).alias("listed"), C.is_common_stock(code).alias("common"), F.substring(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), 1, 2).isin("03", "07").alias("excluded"))


@query("""WITH n AS (SELECT o_orderkey, 'Annual report (' || strftime(o_orderdate, '%Y.%m') || ')' AS name, strftime(o_orderdate, '%Y%m%d') AS d FROM orders)
SELECT o_orderkey, regexp_extract(name, '\\(([0-9]{4})\\.[0-9]{2}\\)', 1)::INT AS year, substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) AS iso FROM n""")
def report_period(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Annual report ("), F.date_format("o_orderdate", "yyyy.MM"), F.lit(")")).alias("name"), F.date_format("o_orderdate", "yyyyMMdd").alias("d"))
    return o.select("o_orderkey", C.report_year(F.col("name")).alias("year"), C.iso_date(F.col("d")).alias("iso"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&cr;|&nbsp;', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text, length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS flat_chars FROM pages")
def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", C.clean_html(F.col("html")).alias("text"), F.length(C.flat_text(F.col("html"))).alias("flat_chars"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_title_extract(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT lower(trim(replace(p_name, ' ', ''))) AS key, regexp_replace(replace(p_name, ' ', ''), '\\([^()]*\\)$', '') AS account, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS concept, count(*) AS n FROM part GROUP BY ALL")
def name_normalise(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return read(spark, sf, "part").groupBy(C.name_key(n).alias("key"), C.strip_parenthesis(n).alias("account"), C.concept_id(n).alias("concept")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE lang = 'en' AND length(text) > 0")
def text_usable(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where("lang = 'en' and length(text) > 0").select("doc_id", F.length("text").alias("n"))


@query("SELECT doc_id, md5(left(text, 4000)) AS head FROM documents")
def text_head(spark: SparkSession, sf: str) -> DataFrame:
    """The stored head of a text, a documented feature of the text layer: 4,000 characters."""
    return read(spark, sf, "documents").select("doc_id", F.md5(F.left("text", F.lit(4000)).cast("binary")).alias("head"))


@query("SELECT year(o_orderdate)::INT AS year, o_orderstatus AS kind, count(*) AS n, bool_or(o_orderpriority = '1-URGENT') AS any_urgent FROM orders GROUP BY ALL")
def availability(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"))


_NOTICE = "WITH p AS (SELECT user_id, list_sort(list(DISTINCT year(ts)::INT)) AS ys FROM events GROUP BY 1), n AS (SELECT user_id, min(year(ts))::INT AS first_year, count(*) AS n FROM events WHERE list_contains(['purchase', 'signup'], event_type) AND user_id % 10 NOT IN (1, 2) GROUP BY 1)"


@query(f"{_NOTICE} SELECT n.user_id, first_year, n, len(list_filter(ys, lambda y: y < first_year)) > 0 AS before, len(list_filter(ys, lambda y: y > first_year)) > 0 AS after FROM n JOIN p USING (user_id)")
def notice_filter(spark: SparkSession, sf: str) -> DataFrame:
    """First year with a notice of one of the kinds, by key, excluded classes left out, and whether the key is present before and after that year."""
    e = read(spark, sf, "events")
    notice = F.col("event_type").isin("purchase", "signup") & ~(F.col("user_id") % 10).isin(1, 2)
    g = e.groupBy("user_id").agg(F.min(F.when(notice, F.year("ts"))).alias("first_year"), F.count_if(notice).alias("n"), F.collect_set(F.year("ts")).alias("ys"))
    return g.where("n > 0").select("user_id", "first_year", "n", F.exists("ys", lambda y: y < F.col("first_year")).alias("before"), F.exists("ys", lambda y: y > F.col("first_year")).alias("after"))


@query(f"SELECT k, n, pct FROM (SELECT c_mktsegment AS k, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT * FROM customer ORDER BY md5('{DEFAULT.seed}|' || c_custkey::VARCHAR) LIMIT 120) GROUP BY 1) ORDER BY n DESC, k LIMIT 5")
def category_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: 120 keys drawn by hash, and their five most frequent categories."""
    s = read(spark, sf, "customer").orderBy(F.md5(F.concat(F.lit(f"{DEFAULT.seed}|"), F.col("c_custkey").cast("string")).cast("binary"))).limit(120)
    g = s.groupBy(F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.expr("round(100.0D * n / sum(n) over (partition by 1), 6)")).orderBy(F.desc("n"), "k").limit(5)


@query(f"WITH s AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY md5('{DEFAULT.seed}|' || firm::VARCHAR)) AS n FROM (WITH {PANEL_SQL} SELECT as_of, firm FROM panel)) SELECT as_of, firm FROM s WHERE n <= {DEFAULT.targets_a_year}")
def target_subsample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: so many targets of each snapshot, by hash."""
    w = F.md5(F.concat(F.lit(f"{DEFAULT.seed}|"), F.col("firm").cast("string")).cast("binary"))
    p = panel(spark, sf).select("as_of", "firm")
    return p.withColumn("n", F.row_number().over(Window.partitionBy("as_of").orderBy(w))).where(F.col("n") <= DEFAULT.targets_a_year).select("as_of", "firm")
