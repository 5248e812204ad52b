"""Small cases whose results can be worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens.config import DEFAULT, RATIOS, SCALE_ACCOUNTS, Config
from peerlens.functions import scalar as C
from peerlens.operators import axes as A
from peerlens.operators import blocks as B
from peerlens.operators import documents as D
from peerlens.operators import govern as G
from peerlens.operators import hashtree as H
from peerlens.operators import relational as R
from peerlens.operators import score as S
from peerlens.operators import statements as X
from peerlens.operators import text as V
from peerlens.plans import panel
from peerlens.sources import tables
from peerlens.streaming import filings


def column(spark, values, kind, f):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in d.orderBy("i").select(f(F.col("v"))).collect()]


def test_point_in_time(spark):
    d = spark.createDataFrame([("2020-05-15",), ("2020-05-16",), ("",), (None,), ("2099-12-31",)], "rcept_dt string")
    assert sorted(r[0] for r in R.known_at(d, F.lit("2020-05-15")).collect()) == ["", "2020-05-15"]
    assert R.violations(d, F.lit("2020-05-15")).count() == 2
    days = column(spark, ["2016-05-14", "2016-05-15", "2017-01-01"], "string", lambda v: R.as_of_date(F.to_date(v), ["2016-05-15", "2017-05-15"]).cast("string"))
    assert days == [None, "2016-05-15", "2016-05-15"]


def pair_axis(spark, name, rows, schema):
    d = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], f"as_of int, firm int, {schema}")
    return {r.peer: r.v for r in A.pairs(d).where("firm = 0").select("peer", A.AXES[name]().alias("v")).collect()}


def test_axes(spark):
    assert pair_axis(spark, "industry", [("26110",), ("26110",), ("26299",), ("10",), ("",)], "code string") == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0}
    assert pair_axis(spark, "industry", [("",), ("",)], "code string") == {1: 0.0}
    got = pair_axis(spark, "scale", [(1.0, 2.0), (1.0, 2.0), (2.0, 2.0), (None, 2.0)], "ln_rev double, ln_ast double")
    assert got[1] == 1 and got[2] == pytest.approx(math.exp(-1)) and got[3] == 0
    scale = lambda vs: spark.createDataFrame([(v,) for v in vs], "g double").agg(A.robust_scale("g")).first()[0]
    assert scale([1.0, 2.0, 4.0, 10.0]) == 3.75 and scale([2.0, 2.0]) == 1 and scale([None]) == 1


def test_baseline_keeps_missing_sizes_last_in_their_tier(spark):
    rows = [(0, "0101", 1.0), (1, "0101", None), (2, "0101", 9.0), (3, "0199", 1.0), (4, "0200", 1.0)]
    d = spark.createDataFrame([(1, f, c, x, 1.0, None, None, None, None, None) for f, c, x in rows], "as_of int, firm bigint, code string, ln_rev double, ln_ast double, ln_cap double, g double, s_n double, s_top double, s_hhi double")
    assert [r.peer for r in B.baseline(d, 9).where("firm = 0").orderBy("rank").collect()] == [2, 1, 3, 4]


def test_growth_over_a_gap_is_null(spark):
    d = spark.createDataFrame([(1, 2018, 100.0), (1, 2020, 150.0), (1, 2021, 300.0)], "firm int, fy int, revenue double")
    assert {r.fy: r.growth for r in panel.growth(d).collect()} == {2018: None, 2020: None, 2021: 1.0}


def test_ratios_cases_and_aggregators(spark):
    schema = "as_of int, firm int, revenue double, assets double, cost double, gross double, op_income double, inventory double, receivables double"
    d = spark.createDataFrame([(1, 1, 100.0, 1.0, 60.0, 40.0, 10.0, 20.0, 0.0), (1, 2, 0.0, 1.0, 6.0, None, 1.0, 2.0, 3.0), (1, 3, None, None, None, None, None, None, None)], schema)
    got = {(r.firm, r.ratio): r.value for r in S.ratio_table(d).collect()}
    assert got[1, "gross_margin"] == 0.4 and got[1, "receivables_turnover"] is None and got[2, "gross_margin"] is None and got[2, "inventory_turnover"] == 3 and got[2, "receivables_turnover"] == 0
    assert all(got[3, r.name] is None for r in RATIOS)
    v = spark.createDataFrame([(1, x, s) for x, s in zip((1.0, 2.0, 4.0, 10.0), (0.4, 0.3, 0.2, 0.1), strict=True)] + [(2, x, 0.0) for x in (1.0, 2.0, 4.0, 10.0)], "g int, v double, sim double")
    got = {r.g: r for r in v.groupBy("g").agg(*[f().alias(n) for n, f in S.AGGREGATORS.items()]).collect()}
    assert (got[1].median, got[1].wmean, got[1].wmedian, got[1].trimmed) == (3, pytest.approx(2.8), 2, 3)
    assert (got[2].wmean, got[2].wmedian) == (4.25, 3)
    r = spark.createDataFrame([(1, 0, "x", 2.0), (1, 1, "x", 1.0), (1, 2, "x", 2.0), (1, 3, "x", 4.0), (1, 4, "x", None), (1, 5, "x", 0.0)], "as_of int, firm int, ratio string, value double")
    p = spark.createDataFrame([(1, 0, i, i, 1.0) for i in range(1, 5)] + [(1, 1, 2, 1, 1.0), (1, 1, 3, 2, 1.0), (1, 5, 1, 1, 1.0)], "as_of int, firm int, peer int, rank int, sim double")
    pen = spark.createDataFrame([(7.0,)], "penalty double")
    cases = {c.firm: (c.ape, c.fail) for c in S.peer_cases(r, p, pen).collect()}
    assert cases == {0: (0.0, False), 1: (7.0, True)}


def test_grades(spark):
    assert column(spark, [0.3, 0.4, 0.5, 0.6, 0.9], "double", lambda v: S.grade(v, F.lit(0.4), F.lit(0.6))) == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]


def test_scalars(spark):
    assert column(spark, ["1,000", "-", "", "12.7", "x", None, "-3.9", "9007199254740993", "NaN"], "string", C.parse_amount) == [1000, None, None, 12, None, None, -3, 9007199254740993, None]
    assert column(spark, ["1,234", "(1,234)", "123", "50.0", "-", "12345", "-5,678"], "string", C.money_cell) == [1234, -1234, None, None, None, 12345, -5678]
    cells = ["(-1,234)", "( 1,234 )", "1 234 567", "(1,234", "1,234)", "1,234.5", "1,23", "-(1,234)", "- 1 234", "()", "", "1,234,56", ",234", "0,123", "٣٤٥٦", None]
    assert column(spark, cells, "string", C.money_cell) == [1234, -1234, 1234567, 1234, 1234, None, None, None, -1234, None, None, None, None, 123, None, None]
    assert column(spark, ["20200515", "2020-05-15", ""], "string", C.iso_date) == ["2020-05-15", "2020-05-15", ""]
    assert column(spark, ["20200515x", "2020"], "string", C.iso_prefix) == ["2020-05-15", ""]
    assert column(spark, ["12", "1234567"], "string", lambda v: C.zero_pad(v, 6)) == ["000012", "1234567"]
    assert column(spark, ["매 출 액 (수익)", "a(b)c"], "string", C.strip_parenthesis) == ["매출액", "a(b)c"]
    assert column(spark, ["ifrs_Revenue1", "-", None], "string", C.concept_id) == ["ifrsrevenue", "", ""]
    assert column(spark, [" Ａ b ", None], "string", C.name_key) == ["ab", None]
    assert column(spark, ["x (2019.12) (2020.06)", "none"], "string", C.report_year) == [2020, None]
    assert column(spark, ["<p>a&nbsp;b</p> \n c"], "string", C.clean_html) == ["a b c"]
    assert column(spark, [1.0, None], "double", lambda v: C.compare("<=", v, F.lit(1.0))) == [True, False]
    assert column(spark, ["900010", "9000", None], "string", C.is_listed) == [True, False, False]


def test_ngrams_ignore_noise(spark):
    d = spark.createDataFrame([(1, "가나 12_é٣!Ａ３"), (2, "ab"), (3, None), (4, "a😀b😀")], "doc int, text string")
    got = {(r.doc, r.gram): r.tf for r in V.term_counts(d, 3).collect()}
    assert got == {(1, "가나_"): 1, (1, "나_é"): 1, (1, "_é٣"): 1, (1, "é٣Ａ"): 1, (1, "٣Ａ３"): 1}
    norms = V.tfidf(spark.createDataFrame([(1, "abcd"), (2, "bcde"), (3, "x")], "doc int, text string"), 3, 10).groupBy("doc").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norms) and len(norms) == 2


def test_presence(spark):
    d = spark.createDataFrame([("a", 2000), ("a", 2002), ("b", 2000), ("c", 2000), ("c", 2001), ("c", 2002), ("c", 2003)], "corp string, year int")
    got = {r.year: (r.absent, r.total) for r in R.missing_survivors(d, "corp", "year").collect()}
    assert got == {2001: (1, 1), 2002: (0, 2)}


def table(rows):
    return "<TABLE>" + "".join("<TR>" + "".join(f"<TD>{c}</TD>" for c in r) + "</TR>" for r in rows) + "</TABLE>"


def test_documents(spark):
    good = table([["Segment", "Revenue", "Share"], ["A", "1,000,000", "50"], ["B", "600,000", "30"], ["C", "400,000", "20"], ["Total", "2,000,000", "100"]])
    docs = {
        1: f"<TITLE>I. Overview</TITLE>x<TITLE>II. Business</TITLE>text &nbsp; here {good}<TITLE>III. Other</TITLE>y",
        2: "no titles at all", 3: "<TITLE>I. Overview</TITLE>x", 4: "<TITLE>II. Business</TITLE>  ", 5: f"<TITLE>II. Business</TITLE>words {table([['q', '1']])}",
        6: f"<TITLE>II. Business</TITLE>{table([['Revenue', 'Share'], ['A', '12']])}", 7: None,
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id int, raw string")
    status = {r.doc_id: r.status for r in D.section(d, "Business").collect()}
    assert status == {1: "ok", 2: "no_titles", 3: "no_section", 4: "empty", 5: "ok", 6: "ok", 7: "no_titles"}
    got = {r.doc_id: tuple(r)[1:] for r in D.segment_profile(d, "Business", ["Revenue"], ["Share"], ["Total"]).collect()}
    assert got[1] == ("ok", 3, 0.5, 0.38) and got[5][0] == "no_table" and got[6][0] == "no_rows" and got[2][0] == "no_section"
    assert [r.found for r in D.accounts_found(d.where("doc_id = 1"), ["A", "Z"]).collect()] == [["A"]]
    spans = D.sections(d.where("doc_id = 1")).first().sections
    assert [r.title for r in spans] == ["I. Overview", "II. Business", "III. Other"] and spans[2].text == "y"
    assert all(docs[1][s.at :].startswith("<TITLE>") and docs[1].find(s.raw) == s.at for s in spans)


def test_section_by_part_of_a_title(spark):
    d = spark.createDataFrame([(1, "<TITLE>Cover</TITLE>a<title class='x'>Ⅱ. The  Business of it</title>b<TITLE>1. Inner</TITLE>c<TITLE>III. Z</TITLE>d")], "doc_id int, raw string")
    r = D.section(d, "Business").first()
    assert (r.status, r.text) == ("ok", "b 1. Inner c")


def test_first_segment_table_with_rows(spark):
    empty, blank = table([["Revenue", "Share"], ["Total", "5,000"]]), table([["Revenue", "Share"], ["", "9,000"], ["A", "3,000"], ["Totals of B", "1,000"]])
    d = spark.createDataFrame([(1, f"<TITLE>II. Business</TITLE>{empty}{blank}")], "doc_id int, raw string")
    assert tuple(D.segment_profile(d, "Business", ["Revenue"], ["Share"], ["Total"]).first())[1:] == ("ok", 2, 0.75, 0.625)
    found = D.accounts_found(spark.createDataFrame([(1, "Net sales grew " + table([["Sales", "-"], ["Cost (net)", "1,000"]]))], "doc_id int, raw string"), ["Sales", "Cost", "Net sales"]).first()
    assert found.found == ["Cost"] and found.mentioned == ["Sales", "Cost", "Net sales"]


def test_choices(spark):
    d = spark.createDataFrame([(0, False, False, False, False), (2, False, False, False, False), (2, True, True, False, False), (2, True, False, True, True), (2, True, False, True, False)], "n int, chosen boolean, trade boolean, summed boolean, elsewhere boolean")
    got = d.select(X.receivable_choice(F.col("n"), F.col("chosen"), F.col("trade"), F.col("summed"), F.col("elsewhere")).alias("r"), X.cost_choice(F.col("n"), F.col("chosen"), F.col("trade"), F.col("elsewhere")).alias("c")).collect()
    assert [r.r for r in got] == ["NA", "NO_PICK", "OK", "APPROX", "DISCLOSURE"] and [r.c for r in got] == ["NA", "NO_PICK", "OK", "MISMAP", "DEFINITIONAL"]
    ids = column(spark, ["shorttermtradereceivable", "tradeandothercurrentreceivables", "", "otherreceivables"], "string", lambda c: X.is_trade_only(c, F.lit("Trade receivables"), ["Tradereceivables"]))
    assert ids == [True, False, True, False]


def test_configuration(spark):
    c = X.read_config("accounts:\n  revenue: {aliases: [Revenue, Net sales], statements: [IS]}\n  cost: {aliases: [Cost], statements: [IS]}\nratios:\n  - {name: margin, numerator: cost, denominator: revenue}\n")
    assert c["ratios"] == [("margin", "cost", "revenue")]
    assert sorted((r.alias, r.priority) for r in X.alias_table(spark, c["accounts"]).where("account = 'revenue'").collect()) == [("Netsales", 1), ("Revenue", 0)]
    with pytest.raises(ValueError):
        X.read_config("ratios: [{name: m, numerator: a, denominator: b}]")


def test_gates(spark):
    key, tables = b"k", {"t": spark.createDataFrame([(1.0,), (2.0,)], "v double")}
    metrics = {"mean": lambda t: t["t"].agg(F.avg("v")), "rows": lambda t: t["t"].agg(F.count("*")), "lost": lambda t: t["missing"].agg(F.count("*")), "fixed": lambda t: t["t"].agg(F.lit(0.0))}
    fine, low = G.Check("mean", "at_most", 5.0), G.Check("rows", "above", 9.0)
    g = G.state_values(G.open_gate("data", [fine], key), {"mean": 1.5}, key)
    assert g.state == G.WAITING and g.authentic(key)
    ok = G.decide(g, tables, metrics, key, "auditor")
    assert ok.state == G.PASSED and ok.outcomes[0].recomputed == 1.5
    G.demand(ok, key)
    assert G.decide(G.state_values(g, {"mean": 1.7}, key), tables, metrics, key, "auditor").state == G.FAILED  # stated otherwise
    assert G.decide(G.state_values(G.open_gate("data", [low], key), {"rows": 2}, key), tables, metrics, key, "auditor").state == G.FAILED  # out of bounds
    assert G.decide(G.state_values(G.open_gate("data", [G.Check("lost", "equals", 0)], key), {"lost": 0}, key), tables, metrics, key, "auditor").state == G.FAILED  # a table is missing
    assert G.decide(G.state_values(G.open_gate("data", [G.Check("none", "equals", 0)], key), {"none": 0}, key), tables, metrics, key, "auditor").state == G.FAILED  # no such metric
    from dataclasses import replace

    forged = replace(g, checks=(G.Check("mean", "at_most", 50.0),))
    assert not forged.authentic(key) and G.decide(forged, tables, metrics, key, "auditor").state == G.FAILED
    with pytest.raises(SystemExit):
        G.demand(replace(ok, stated=(("mean", 1.0),)), key)
    import hashlib

    tokens = {"ann": hashlib.sha256(b"secret").hexdigest()}
    done = G.approve(ok, "ann", "secret", tokens, key)
    assert done.state == G.APPROVED and done.by == "ann" and ok.seal in done.history
    for gate, person, token in ((ok, "ann", "wrong"), (ok, "bob", "secret"), (g, "ann", "secret")):
        with pytest.raises(PermissionError):
            G.approve(gate, person, token, tokens, key)
    again = G.amend(done, [G.Check("mean", "at_most", 1.0)], "bound was too wide", key)
    assert again.state == G.WAITING and again.authentic(key) and G.decide(again, tables, metrics, key, "auditor").state == G.FAILED
    with pytest.raises(SystemExit):
        G.demand(again, key)
    double = {"t": lambda d: d.withColumn("v", F.col("v") * 2)}
    assert G.never_moves(metrics["fixed"], tables, double) and not G.never_moves(metrics["mean"], tables, double)


def test_seals_and_leaks(spark):
    text, digest = G.seal({"weights": DEFAULT.weights, "k": 10})
    assert G.unseal(text, digest)["k"] == 10 and G.seal({"k": 10, "weights": DEFAULT.weights}) == (text, digest)
    with pytest.raises(ValueError):
        G.unseal(text + " ", digest)
    specs = [(r.name, r.numerator, r.denominator) for r in RATIOS]
    leaks = lambda s: [r.ratio for r in G.shared_sides(spark, s, list(SCALE_ACCOUNTS)).collect()]
    assert leaks(specs) == [] and leaks([*specs, ("leak", "revenue", "assets")]) == ["leak"]
    assert sum(Config(weights={"a": 2.0, "b": 6.0}).normal_weights.values()) == 1


def test_labels_of_content(spark):
    d = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    label = G.content_label(d, ["k"], ["v"])
    assert G.label_agrees(d.orderBy(F.desc("k")), label, ["k"], ["v"]) and not G.label_agrees(d.withColumn("v", F.lit(1)), label, ["k"], ["v"])


def test_digests_ignore_row_order(spark):
    rows = [("a", 1), ("b", 2), ("c", None)]
    def of(r):
        d = spark.createDataFrame(r, "k string, v int")
        return H.root(d, F.col("k"), F.coalesce(F.col("v").cast("string"), F.lit("")), 1).first().digest, d.agg(C.order_free_digest(F.col("k"), F.col("v"))).first()[0]

    assert of(rows) == of(rows[::-1]) and all(x != y for x, y in zip(of(rows), of([("a", 1), ("b", 3), ("c", None)]), strict=True))


def test_sources(spark, tmp_path):
    p = tmp_path / "ledger.csv"
    p.write_text("﻿corp_code,corp_name,corp_cls,stock_code,rcept_dt,report_nm\n00000007,A,Y,900010,20200330,r\n00000001,B,,,,\n", encoding="utf-8")
    got = {r.corp_code: r for r in tables.read_ledger(spark, str(p)).collect()}
    assert got["00000007"].rcept_dt == "2020-03-30" and got["00000001"].stock_code == ""
    layer = spark.createDataFrame([(2020, "a", 5.0), (2021, "a", None)], "as_of int, corp string, amount double")
    tables.write_layer(layer, str(tmp_path / "layer"), ("amount",))
    schema = T.StructType([T.StructField("corp", T.StringType()), T.StructField("amount", T.LongType()), T.StructField("as_of", T.IntegerType())])
    assert [r.amount for r in tables.read_layer(spark, str(tmp_path / "layer"), schema, 2020).collect()] == [5]
    assert tables.read_layer(spark, str(tmp_path / "layer"), schema, 1999).count() == 0
    (tmp_path / "c.jsonl").write_text('{"k":"a","n":1,"v":"x"}\n{"k":"a","n":2,"v":"y"}\n')
    assert [r.v for r in tables.read_checkpoint(spark, str(tmp_path / "c.jsonl"), T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType()), T.StructField("v", T.StringType())]), "k", "n").collect()] == ["y"]
    rep = spark.createDataFrame([(1, 2020, "HIGH", [(1, 7, 0.5, (0.3, 0.2))])], "firm int, as_of int, grade string, peers array<struct<rank:int,peer:int,sim:double,why:struct<industry:double,scale:double>>>")
    tables.write_report_csv(rep, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["firm", "as_of", "grade", "rank", "peer", "sim", "why_industry", "why_scale"]
    tables.write_report_json(rep, str(tmp_path / "json"))
    assert '"grade":"HIGH"' in spark.read.text(str(tmp_path / "json")).first()[0]


def test_stream_of_filings(spark, tmp_path):
    d = spark.createDataFrame([(1, "2020-01-01 00:00:00"), (1, "2020-02-01 00:00:00"), (2, "2020-01-05 00:00:00")], "firm int, at string").select("firm", F.col("at").cast("timestamp").alias("rcept_dt"))
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = filings.latest(s).writeStream.outputMode("complete").format("memory").queryName("latest_filings").start()
    try:
        q.processAllAvailable()
        assert {r.firm: r.n for r in spark.table("latest_filings").collect()} == {1: 2, 2: 1}
    finally:
        q.stop()
    assert filings.counts(s).isStreaming
