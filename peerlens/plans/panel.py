"""Adapter from the star schema to a panel of firms: one row for each firm and snapshot, as DataFrame and as SQL.

A firm is a supplier; a snapshot is May 15 of a year, and its accounts are those of the fiscal year before. Sums of products with four decimals are
rounded to four decimals, so the order of addition doesn't show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.config import DEFAULT
from peerlens.sources.contexts import Contexts


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """firm, name, market value and hierarchical industry code (2 digits of region, 3 of nation)."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    code = F.concat(F.lpad(F.col("n_regionkey").cast("string"), 2, "0"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("firm"), F.col("s_name").alias("name"), code.alias("code"), F.col("s_acctbal").alias("mktcap"))


def lines(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """The lines of all years, or from the first to the last of two, which the scan of the files already leaves out."""
    d = read(spark, sf_dir, "lineitem")
    if years is not None:
        day = lambda y: F.lit(f"{y}-01-01 00:00:00").cast(d.schema["l_shipdate"].dataType)
        d = d.where((F.col("l_shipdate") >= day(years[0])) & (F.col("l_shipdate") < day(years[1] + 1)))
    return d.select(
        F.col("l_suppkey").alias("firm"), F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("day"), F.year("l_shipdate").alias("fy"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """firm, fy and the accounts of the fiscal year."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("retail"))
    net = F.col("price") * (1 - F.col("disc"))
    total = lambda c, name: F.round(F.sum(c), 4).alias(name)
    a = lines(spark, sf_dir).join(p, "part").groupBy("firm", "fy").agg(
        total(net, "revenue"), total(F.col("price") * (1 + F.col("tax")), "assets"), total(F.col("qty") * F.col("retail"), "cost"), total(F.col("price") * F.col("tax"), "taxes"),
        total(F.when(F.col("status") == "O", net).otherwise(0.0), "inventory"), total(F.when(F.col("flag") == "N", net).otherwise(0.0), "receivables"))
    a = a.withColumn("gross", F.round(F.col("revenue") - F.col("cost"), 4))
    return a.withColumn("op_income", F.round(F.col("gross") - F.col("taxes"), 4)).drop("taxes")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """firm, year, rcept_dt: the first filing of each firm between January 1 and the snapshot day."""
    return lines(spark, sf_dir).where(F.date_format("day", "MMdd") <= "0515").groupBy("firm", F.col("fy").alias("year")).agg(F.min("day").alias("rcept_dt"))


def growth(a: DataFrame) -> DataFrame:
    """Year over year by an equality of years: a missing year gives a null, not a longer step."""
    prev = a.select("firm", (F.col("fy") + 1).alias("fy"), F.col("revenue").alias("before"))
    return a.join(prev, ["firm", "fy"], "left").select("firm", "fy", F.when(F.col("before") > 0, F.col("revenue") / F.col("before") - 1).alias("growth"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of a firm's revenue by part type: number of segments, top share, sum of squared shares."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("segment"))
    by = lines(spark, sf_dir).join(p, "part").groupBy("firm", "fy", "segment").agg(F.round(F.sum(F.col("price") * (1 - F.col("disc"))), 4).alias("v"))
    total = by.groupBy("firm", "fy").agg(F.round(F.sum("v"), 4).alias("total"))
    share = by.join(total, ["firm", "fy"]).where("v > 0 and total > 0").withColumn("share", F.col("v") / F.col("total"))
    return share.groupBy("firm", "fy").agg(F.count("*").alias("seg_n"), F.round(F.max("share"), 9).alias("seg_top"), F.round(F.sum(F.col("share") * F.col("share")), 6).alias("seg_hhi"))


#: So many parts at most are sent to the lines (some 100 bytes each); beyond, lines are shuffled to the parts.
FEW_PARTS = 2_000_000


def rollup(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """firm, fy, rcept_dt (first filing between January 1 and the snapshot day), has (whether there are accounts), accounts, segment profile: one scan of the lines, first by segment, then by year.

    Few parts are sent to the lines, so that lines are added up where they are read and only sums by firm, year and segment are shuffled.
    """
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("retail"), F.col("p_type").alias("segment"), F.lit(True).alias("known"))
    p = F.broadcast(p) if p.count() <= FEW_PARTS else p
    net, ok = F.col("price") * (1 - F.col("disc")), F.col("known")
    of = lambda c, name: F.sum(F.when(ok, c)).alias(name)
    by = lines(spark, sf_dir, years).join(p, "part", "left").groupBy("firm", "fy", "segment").agg(
        F.min(F.when(F.date_format("day", "MMdd") <= "0515", F.col("day"))).alias("rcept_dt"), F.count("known").alias("known"), of(net, "revenue"), of(F.col("price") * (1 + F.col("tax")), "assets"), of(F.col("qty") * F.col("retail"), "cost"),
        of(F.col("price") * F.col("tax"), "taxes"), of(F.when(F.col("status") == "O", net).otherwise(0.0), "inventory"), of(F.when(F.col("flag") == "N", net).otherwise(0.0), "receivables"))
    total = lambda c: F.round(F.sum(c), 4).alias(c)
    v = F.collect_list(F.when(F.col("known") > 0, F.round("revenue", 4))).alias("v")  # one number for each part type
    y = by.groupBy("firm", "fy").agg(F.min("rcept_dt").alias("rcept_dt"), (F.sum("known") > 0).alias("has"), *map(total, ("revenue", "assets", "cost", "taxes", "inventory", "receivables")), v)
    y = y.withColumn("total", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4))
    y = y.withColumn("shares", F.when(F.col("total") > 0, F.transform(F.filter("v", lambda x: x > 0), lambda x: x / F.col("total"))))
    some = F.size("shares") > 0
    y = y.withColumn("gross", F.round(F.col("revenue") - F.col("cost"), 4))
    return y.select(
        "firm", "fy", "rcept_dt", "has", "revenue", "assets", "cost", "gross", F.round(F.col("gross") - F.col("taxes"), 4).alias("op_income"), "inventory", "receivables",
        F.when(some, F.size("shares").cast("bigint")).alias("seg_n"), F.when(some, F.round(F.array_max("shares"), 9)).alias("seg_top"),
        F.when(some, F.round(F.aggregate("shares", F.lit(0.0), lambda a, x: a + x * x), 6)).alias("seg_hhi"))


ACCOUNTS = ("revenue", "assets", "cost", "gross", "op_income", "inventory", "receivables")
SEGMENT = ("seg_n", "seg_top", "seg_hhi")


def build_panel(spark: SparkSession, sf_dir: str, years: tuple[int, ...] = DEFAULT.snapshot_years) -> DataFrame:
    """as_of (year of the snapshot), firm, code, rcept_dt, accounts, mktcap, growth, segment profile; only firms that filed by the snapshot day.

    The accounts are those of the year before, by a step back that counts only if it is one year; growth takes one more such step. Lines of other years aren't read.
    """
    w = Window.partitionBy("firm").orderBy("fy")
    y = rollup(spark, sf_dir, (min(years) - 2, max(years)))
    y = y.select("firm", "fy", "rcept_dt", F.lag(F.struct("fy", "has", *ACCOUNTS, *SEGMENT), 1).over(w).alias("x"), F.lag(F.struct("fy", "revenue"), 2).over(w).alias("z"))
    y = y.where(F.col("fy").isin(*years) & F.col("rcept_dt").isNotNull() & (F.col("x.fy") == F.col("fy") - 1) & F.col("x.has"))
    growth = F.when((F.col("z.fy") == F.col("fy") - 2) & (F.col("z.revenue") > 0), F.col("x.revenue") / F.col("z.revenue") - 1)
    y = y.select(F.col("fy").alias("as_of"), "firm", "rcept_dt", *[F.col(f"x.{c}").alias(c) for c in ACCOUNTS], growth.alias("growth"), *[F.col(f"x.{c}").alias(c) for c in SEGMENT])
    return y.join(firms(spark, sf_dir), "firm", "left")


#: Panels and single snapshots that Spark keeps.
KEPT = Contexts(4)
_SOURCES = ("lineitem", "part", "supplier", "nation")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of all snapshots, kept by Spark after its first use (a row for each firm and snapshot; what a lost executor held is made again). See KEPT."""
    return KEPT.get(spark, ("panel", sf_dir), [f"{sf_dir}/{t}.parquet" for t in _SOURCES], lambda: build_panel(spark, sf_dir))


def snapshot(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """The panel of one snapshot, made from the lines of its three years and kept like panel()."""
    return KEPT.get(spark, ("snapshot", sf_dir, year), [f"{sf_dir}/{t}.parquet" for t in _SOURCES], lambda: build_panel(spark, sf_dir, (year,)))


def forget_context() -> None:
    """Drops all that panel() and snapshot() keep."""
    KEPT.clear()


#: The same as common table expressions for DuckDB: firms, acc, filings, growth, seg, panel.
PANEL_SQL = f"""
firms AS (SELECT s_suppkey AS firm, s_name AS name, lpad(n_regionkey::VARCHAR, 2, '0') || lpad(n_nationkey::VARCHAR, 3, '0') AS code, s_acctbal AS mktcap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
li AS (SELECT l_suppkey AS firm, l_partkey AS part, l_shipdate::DATE AS day, year(l_shipdate)::INT AS fy, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc,
  l_tax AS tax, l_linestatus AS status, l_returnflag AS flag FROM lineitem),
acc0 AS (SELECT firm, fy, round(sum(price * (1 - disc)), 4) AS revenue, round(sum(price * (1 + tax)), 4) AS assets, round(sum(qty * p_retailprice), 4) AS cost,
  round(sum(price * tax), 4) AS taxes, round(sum(CASE WHEN status = 'O' THEN price * (1 - disc) ELSE 0.0 END), 4) AS inventory,
  round(sum(CASE WHEN flag = 'N' THEN price * (1 - disc) ELSE 0.0 END), 4) AS receivables FROM li JOIN part ON part = p_partkey GROUP BY firm, fy),
acc AS (SELECT firm, fy, revenue, assets, cost, inventory, receivables, round(revenue - cost, 4) AS gross, round(round(revenue - cost, 4) - taxes, 4) AS op_income FROM acc0),
filings AS (SELECT firm, fy AS year, min(day) AS rcept_dt FROM li WHERE strftime(day, '%m%d') <= '0515' GROUP BY firm, fy),
growth AS (SELECT a.firm, a.fy, CASE WHEN b.revenue > 0 THEN a.revenue / b.revenue - 1 END AS growth FROM acc a LEFT JOIN acc b ON a.firm = b.firm AND b.fy = a.fy - 1),
segv AS (SELECT firm, fy, p_type AS segment, round(sum(price * (1 - disc)), 4) AS v FROM li JOIN part ON part = p_partkey GROUP BY ALL),
segt AS (SELECT firm, fy, round(sum(v), 4) AS total FROM segv GROUP BY ALL),
seg AS (SELECT firm, fy, count(*) AS seg_n, round(max(v / total), 9) AS seg_top, round(sum((v / total) * (v / total)), 6) AS seg_hhi
  FROM segv JOIN segt USING (firm, fy) WHERE v > 0 AND total > 0 GROUP BY firm, fy),
panel AS (SELECT f.year AS as_of, f.firm, f.rcept_dt, a.revenue, a.assets, a.cost, a.gross, a.op_income, a.inventory, a.receivables, g.growth, s.seg_n, s.seg_top, s.seg_hhi,
  m.name, m.code, m.mktcap
  FROM filings f JOIN acc a ON a.firm = f.firm AND a.fy = f.year - 1 LEFT JOIN growth g ON g.firm = f.firm AND g.fy = f.year - 1
  LEFT JOIN seg s ON s.firm = f.firm AND s.fy = f.year - 1 LEFT JOIN firms m ON m.firm = f.firm WHERE f.year IN {DEFAULT.snapshot_years})
"""
