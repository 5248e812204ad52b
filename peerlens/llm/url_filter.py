"""URL filters: rules on hosts and paths, found through short hash prefixes.

Each url is expanded into (host suffix, path prefix) expressions, of the lengths that rules have. A 32-bit prefix of an expression's
SHA-256 is joined with the rules' prefixes; the full digests then confirm, and the longest fitting rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, few, pick

#: Rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", most_broadcast: int = 200_000) -> DataFrame:
    """Verdict of every page's url by rules (host, path, verdict).

    A rule fits its host and all subdomains of it if the path starts with the rule's path; the longest rule (host and path
    together; then the longer host, then "block" before other verdicts) wins. Without a rule the verdict is `default`.
    Returns page_id, host, path, rule (host and path together, or null), verdict; one row for each row of pages, repeated rows included.
    A null url or one without "://" has an empty host and path. Rules with a null are ignored. Further columns are ignored.
    """
    r = pick(rules, host="string", path="string", verdict="string").dropna()
    r = r.groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.min(F.struct((F.col("verdict") != "block").alias("o"), "verdict")).alias("v"))
    r = r.select(F.concat("host", F.lit("\n"), "path").alias("expression"), "host", "path", F.col("v.verdict").alias("verdict"))
    digest = F.sha2("expression", 256)
    r = r.select(F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("bigint").alias("short"), digest.alias("digest"), F.struct(
        (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), (F.col("verdict") == "block").alias("strict"),
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict")).alias("found"))
    # Path lengths and label counts that occur in rules: at most as many numbers as the longest path has characters, or the longest host labels.
    known = pick(rules, host="string", path="string", verdict="string").dropna()
    lengths = sorted(x[0] for x in known.select(F.length("path")).distinct().collect())
    counts = sorted(x[0] for x in known.select(F.size(F.split("host", r"\."))).distinct().collect())

    host, path = host_and_path(F.col("url"))
    p = pick(pages, page_id="", url="string").select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    # Only suffixes of so many labels as some rule's host has: a url of thousands of labels makes no more of them than any other.
    last = lambda n: F.when(F.size(labels) >= n, F.substring_index("host", ".", -n))
    suffixes = F.filter(F.array(*[last(n) for n in counts]), lambda x: x.isNotNull()) if counts else F.array().cast("array<string>")
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.left("path", F.lit(n))) for n in lengths]), lambda x: x.isNotNull())
    prefixes = prefixes if lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda q: F.concat(s, F.lit("\n"), q))))
    # The url itself comes first, without an expression, so that each row remains and equal rows are counted.
    e = p.select("page_id", "host", "path", F.explode(F.concat(F.array(F.lit(None).cast("string")), pairs)).alias("expression"))
    e = e.select("page_id", "host", "path", F.col("expression").isNull().alias("row"), F.sha2("expression", 256).alias("digest"))
    e = e.withColumn("short", F.conv(F.substr("digest", F.lit(1), F.lit(8)), 16, 10).cast("bigint"))
    joined = e.alias("e").join(F.broadcast(r).alias("r") if few(r, most_broadcast) else r.alias("r"), F.expr("e.short = r.short"), "left")
    found = F.when(F.col("e.digest") == F.col("r.digest"), F.col("r.found"))
    best = joined.where(F.col("row") | F.col("r.short").isNotNull()).groupBy("page_id", "e.host", "e.path").agg(F.sum(F.col("row").cast("int")).alias("copies"), F.max(found).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), "copies")).alias("nth")).drop("nth")
