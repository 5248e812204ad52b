"""Scalar functions on Columns; all stay in the JVM but for Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(s: Column) -> Column:
    """Eight digits become a dashed date; anything else is unchanged."""
    return F.when(s.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))).otherwise(s)


def iso_prefix(s: Column) -> Column:
    """The first eight characters as a dashed date, "" if there are fewer."""
    return F.when(F.length(s) >= 8, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))).otherwise("")


def parse_amount(s: Column) -> Column:
    """bigint of a number with commas, fractions cut off; null for "", "-" and what is no number. Whole numbers keep all their digits."""
    t = F.regexp_replace(F.trim(s), ",", "")
    d = t.try_cast("double")
    return F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint")), F.when(~F.isnan(d) & (F.abs(d) < 9.2e18), F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("bigint")))


def money_cell(s: Column) -> Column:
    """Number of a table cell that looks like money: digits grouped by commas, or four of them or more; null for anything else, fractions included.

    Blanks don't count. Both parentheses together negate, and so does a minus sign within them, so that both leave a positive number; one parenthesis alone changes nothing.
    """
    t = F.regexp_replace(s, " ", "")
    inner = F.regexp_replace(t, r"^\(|\)$", "")
    bare = F.regexp_replace(inner, "^-", "")
    groups, digits = F.split(bare, ","), F.regexp_replace(bare, ",", "")
    grouped = (F.size(groups) > 1) & F.length(groups[0]).between(1, 3) & F.forall(F.slice(groups, F.lit(2), F.size(groups)), lambda g: F.length(g) == 3)
    money = (grouped | ((F.size(groups) == 1) & (F.length(bare) >= 4))) & digits.rlike("^[0-9]+$")
    value = digits.try_cast("double")
    return F.when(money, F.when((t.startswith("(") & t.endswith(")")) != inner.startswith("-"), -value).otherwise(value))


def clean_html(s: Column) -> Column:
    """Tags and the entities &cr; and &nbsp; become spaces; white space is collapsed."""
    t = F.regexp_replace(F.regexp_replace(s, "<[^>]*>", " "), "&cr;|&nbsp;", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def flat_text(s: Column) -> Column:
    """Without tags and any white space."""
    return F.regexp_replace(F.regexp_replace(s, "<[^>]*>", ""), r"\s+", "")


def name_key(s: Column) -> Column:
    """NFKC, without spaces, lower case; one vectorised pass, in which ASCII names are only handed through."""

    @F.pandas_udf("string")
    def nfkc(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))

    return F.lower(F.trim(F.regexp_replace(nfkc(s), " ", "")))


def ascii_name_key(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, " ", "")))


def zero_pad(s: Column, n: int) -> Column:
    """Pads short codes; longer ones aren't cut."""
    return F.when(F.length(s) < n, F.lpad(s, n, "0")).otherwise(s)


def strip_parenthesis(s: Column) -> Column:
    """An account name without spaces and without a last parenthesis."""
    return F.regexp_replace(F.regexp_replace(s, " ", ""), r"\([^()]*\)$", "")


def concept_id(s: Column, unused: str = "-") -> Column:
    """Letters a to z of the lower-cased id; "" for the marker of unused ids."""
    return F.when(F.coalesce(s, F.lit("")) == unused, "").otherwise(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z]", ""))


def is_listed(code: Column) -> Column:
    return F.coalesce(code.rlike("^[0-9]{6}$"), F.lit(False))


def is_common_stock(code: Column) -> Column:
    return F.coalesce(code.endswith("0"), F.lit(False))


def report_year(name: Column) -> Column:
    """Year of the last "(YYYY.MM)" in a report's name."""
    found = F.regexp_extract_all(name, F.lit(r"\(([0-9]{4})\.[0-9]{2}\)"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("int"))


def compare(op: str, x: Column, y: Column) -> Column:
    """One of <=, <, >=, >, ==; a null makes it false."""
    table = {"<=": x <= y, "<": x < y, ">=": x >= y, ">": x > y, "==": x == y}
    return F.coalesce(table[op], F.lit(False))


def order_free_digest(*columns: Column) -> Column:
    """Aggregate that doesn't depend on row order and needs no sort: count and sum of 64-bit hashes."""
    return F.concat_ws("-", F.count("*").cast("string"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string"))
