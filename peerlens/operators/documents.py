"""Sections and tables of filings, with built-in functions: a document is cut at its titles, a section at its tables, rows and cells.

Titles are TITLE elements; a top-level one begins with a Roman numeral (letters, or the numeral characters of Unicode) and a full stop. Cells are TD, TH, TE or TU elements.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.functions import scalar as C

#: Element names of cells.
CELLS = ("TD", "TE", "TH", "TU")
#: A Roman numeral and a full stop at the start of a title; U+2160 to U+217F are the numerals as characters.
NUMERAL = "^\\s*(?:[IVXLC]+|[\\u2160-\\u217F]+)\\s*\\."


def elements(raw: Column, *names: str) -> Column:
    """array<string>: contents of the elements of these names, in order; such elements don't nest in filings."""
    parts = F.split(raw, f"(?i)<(?=(?:{'|'.join(names)})\\b)")
    inner = lambda p: F.regexp_replace(F.substr(p, F.instr(p, ">") + 1), f"(?is)</(?:{'|'.join(names)})\\b.*", "")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), inner)


def sections(docs: DataFrame) -> DataFrame:
    """docs with n_titles and sections: array<struct<at, title, raw, text>> of the top-level sections, in order. `at` is the offset of the title, raw the span to the next one, text the cleaned body."""
    d = docs.withColumn("source", F.coalesce("raw", F.lit("")))
    parts = F.split("source", "(?i)(?=<TITLE\\b)")
    d = d.withColumn("parts", parts)
    # Every piece knows where it starts; pieces whose title isn't a top-level one belong to the section before.
    start = F.transform("parts", lambda p, i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda n, q: n + F.length(q)))
    title = lambda p: F.when(p.rlike("(?is)^<TITLE\\b"), C.clean_html(F.get(elements(p, "TITLE"), F.lit(0))))
    d = d.withColumn("marks", F.arrays_zip(start.alias("at"), F.transform("parts", title).alias("title")))
    d = d.withColumn("n_titles", F.size(F.filter("marks", lambda m: m["title"].isNotNull())))
    d = d.withColumn("tops", F.filter("marks", lambda m: m["title"].rlike(NUMERAL)))
    after = lambda i: F.coalesce(F.get(F.col("tops"), i + 1)["at"], F.length("source"))
    span = lambda m, i: F.substr(F.col("source"), m["at"] + 1, after(i) - m["at"])
    body = lambda s: C.clean_html(F.regexp_replace(s, "(?is)^<TITLE\\b.*?</TITLE>", ""))
    found = F.transform("tops", lambda m, i: F.struct(m["at"].alias("at"), m["title"].alias("title"), span(m, i).alias("raw"), body(span(m, i)).alias("text")))
    return d.withColumn("sections", found).drop("source", "parts", "marks", "tops")


def section(docs: DataFrame, wanted: str) -> DataFrame:
    """doc_id, status (ok, no_titles, no_section, empty), text, raw of the first section whose title, without numeral and spaces, contains the wanted one."""
    name = "".join(wanted.split())
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, NUMERAL, ""), "\\s", "")
    d = sections(docs).withColumn("hit", F.get(F.filter("sections", lambda s: F.contains(bare(s["title"]), F.lit(name))), F.lit(0)))
    status = F.when(F.size("sections") <= 0, "no_titles").when(F.col("hit").isNull(), "no_section").when(F.col("hit.text") == "", "empty").otherwise("ok")
    return d.select("doc_id", status.alias("status"), F.when(status == "ok", F.col("hit.text")).alias("text"), F.when(status == "ok", F.col("hit.raw")).alias("raw"))


def table_rows(raw: Column) -> Column:
    """array<array<array<string>>>: the cleaned cells of each row of each table."""
    rows = lambda t: elements(t, "TR")
    return F.transform(elements(raw, "TABLE"), lambda t: F.transform(rows(t), lambda r: F.transform(elements(r, *CELLS), lambda c: C.clean_html(c))))


def labelled_amounts(rows: Column) -> Column:
    """array<struct<label, amounts>> of rows with a label that isn't blank: first cell, and the money cells of all others, however many."""
    one = lambda r: F.struct(F.get(r, F.lit(0)).alias("label"), F.filter(F.transform(F.slice(r, F.lit(2), F.size(r)), lambda c: C.money_cell(c)), lambda v: v.isNotNull()).alias("amounts"))
    return F.filter(F.transform(F.filter(rows, lambda r: F.size(r) > 1), one), lambda x: x["label"] != "")


def segment_profile(docs: DataFrame, wanted: str, revenue: list[str], composition: list[str], totals: list[str]) -> DataFrame:
    """doc_id, status, seg_n, seg_top_share, seg_hhi of a section's segments.

    Tables that name revenue and composition are taken in order until one has rows: labelled ones, not totals (whole labels), with a positive money cell, the largest
    of which is the row's revenue. status: ok, no_section, no_table (none names both), no_rows (none of those has rows).
    """
    s = section(docs, wanted).withColumn("tables", table_rows(F.col("raw")))
    names = lambda t, words: reduce(lambda a, b: a | b, [F.contains(F.array_join(F.flatten(t), " "), F.lit(w)) for w in words])
    value = lambda x: F.array_max(F.filter(x["amounts"], lambda v: v > 0))
    rows = lambda t: F.transform(F.filter(labelled_amounts(t), lambda x: ~x["label"].isin(totals) & value(x).isNotNull()), value)
    s = s.withColumn("fitting", F.transform(F.filter("tables", lambda t: names(t, revenue) & names(t, composition)), rows))
    s = s.withColumn("values", F.get(F.filter("fitting", lambda v: F.size(v) > 0), F.lit(0)))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    s = s.withColumn("shares", F.transform("values", lambda x: x / total))
    status = F.when(F.col("status") != "ok", F.lit("no_section")).when(F.size("fitting") <= 0, "no_table").when(F.col("values").isNull(), "no_rows").otherwise("ok")
    ok = status == "ok"
    return s.select(
        "doc_id", status.alias("status"), F.when(ok, F.size("shares")).alias("seg_n"), F.when(ok, F.round(F.array_max("shares"), 6)).alias("seg_top_share"),
        F.when(ok, F.round(F.aggregate("shares", F.lit(0.0), lambda a, x: a + x * x), 6)).alias("seg_hhi"))


def accounts_found(docs: DataFrame, aliases: list[str]) -> DataFrame:
    """doc_id, found (aliases that label a table row with a money cell) and mentioned (aliases that the text has anywhere, spaces aside)."""
    r = docs.select("doc_id", labelled_amounts(F.flatten(table_rows(F.coalesce("raw", F.lit(""))))).alias("rows"), C.flat_text(F.coalesce("raw", F.lit(""))).alias("flat"))
    labels = F.transform(F.filter("rows", lambda x: F.size(x["amounts"]) > 0), lambda x: C.strip_parenthesis(x["label"]))
    wanted = F.array(*map(F.lit, aliases))
    return r.select("doc_id", F.array_intersect(wanted, labels).alias("found"), F.filter(wanted, lambda a: F.contains("flat", F.regexp_replace(a, "\\s", ""))).alias("mentioned"))
