"""Which of many strings hold which, by an index of q-grams instead of a comparison of each two.

A string can only hold another one that is not empty if it has all of its grams, so also its rarest one. Postings of grams are joined on that one gram alone, and what
comes of it is confirmed. Both joins are equalities, which Spark shuffles and splits where a gram is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of grams; a shorter string is a gram by itself.
Q = 3


def grams(s: Column, q: int | Column) -> Column:
    """Distinct grams of q characters; none of a string that is shorter."""
    n = F.length(s) - q + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(s, i, F.lit(q) if isinstance(q, int) else q)))).otherwise(F.array().cast("array<string>"))


def holding(long: DataFrame, short: DataFrame, q: int = Q) -> DataFrame:
    """long, short: each pair of distinct strings (column `s` of both tables) of which the first holds the second; equal ones too, empty ones never."""
    a, b = (d.select("s").where("s <> ''").distinct() for d in (long, short))
    size = F.least(F.length("s"), F.lit(q))
    sizes = [r[0] for r in b.select(size).distinct().collect()]  # at most q numbers
    if not sizes:
        return a.select(F.col("s").alias("long"), F.col("s").alias("short")).limit(0)
    post = a.select(F.col("s").alias("long"), F.explode(F.flatten(F.array(*[grams(F.col("s"), n) for n in sorted(sizes)]))).alias("gram"))
    df = post.groupBy("gram").agg(F.count("*").alias("df"))
    own = b.select(F.col("s").alias("short"), F.explode(grams(F.col("s"), size)).alias("gram")).join(df, "gram", "left")
    rare = own.groupBy("short").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).where("g.df > 0").select("short", "g.gram")
    return post.join(rare, "gram").where(F.contains("long", "short")).select("long", "short")


def either_way(names: DataFrame, asked: DataFrame, q: int = Q) -> DataFrame:
    """name, asked: each pair of which one holds the other."""
    n, a = (d.select("s").distinct() for d in (names, asked))
    there, back = holding(n, a, q), holding(a, n, q)
    return there.select(F.col("long").alias("name"), F.col("short").alias("asked")).union(back.select(F.col("short").alias("name"), F.col("long").alias("asked"))).distinct()
