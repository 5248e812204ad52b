"""Point-in-time filters, look-ups, presence statistics, audits and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def known_at(df: DataFrame, day: Column, date: str = "rcept_dt") -> DataFrame:
    """Rows filed on or before the day. A null date is out; an empty string, where dates are strings, sorts first and is in."""
    return df.where(F.col(date) <= day)


def violations(df: DataFrame, day: Column, date: str = "rcept_dt") -> DataFrame:
    """Rows filed after the day."""
    return df.where(F.col(date) > day)


def as_of_date(day: Column, snapshots: list[str]) -> Column:
    """The latest of the snapshot days (ISO strings) that isn't after `day`; null before the first. The directory of snapshots is one short literal."""
    found = F.filter(F.array(*[F.to_date(F.lit(s)) for s in snapshots]), lambda s: s <= day)
    return F.array_max(found)


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """For each left row the values of the latest right row of the same key with right_on <= left_on.

    Union, one shuffle on the key, and a running last value: no range join, and a key's rows are sorted once.
    """
    both = left.withColumns({"__t": F.col(left_on), "__o": F.lit(1), "__v": F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType)})
    r = right.select(key, F.col(right_on).alias("__t"), F.lit(0).alias("__o"), F.struct(*values).alias("__v"))
    w = Window.partitionBy(key).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = both.unionByName(r, allowMissingColumns=True).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return u.where("__o = 1").select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def few(df: DataFrame, most: int) -> bool:
    """Whether df has no more than so many rows; reads no more than that."""
    return df.limit(most + 1).count() <= most


def first_row(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row for each group: the first in the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def latest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, value of the largest order: an aggregate with map-side combine, no sort."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def presence(df: DataFrame, key: str, year: str) -> DataFrame:
    """key, first, last, years of the distinct (key, year) pairs."""
    return df.select(key, year).distinct().groupBy(key).agg(F.min(year).alias("first"), F.max(year).alias("last"), F.count("*").alias("years"))


def missing_survivors(df: DataFrame, key: str, year: str) -> DataFrame:
    """year, absent, total, pct: keys seen before a year, absent in it, and back within two years, against the year's keys.

    The years of a key are one small array, so the whole matrix is one aggregation and one explode.
    """
    seen = df.select(key, year).distinct()
    span = seen.agg(F.min(year).alias("low"), F.max(year).alias("high"))
    k = seen.groupBy(key).agg(F.collect_set(year).alias("ys")).crossJoin(F.broadcast(span))  # one row on the right
    k = k.withColumn("t", F.explode(F.sequence(F.col("low") + 1, F.col("high") - 1)))
    gone = (F.array_min("ys") < F.col("t")) & ~F.array_contains("ys", F.col("t")) & (F.array_contains("ys", F.col("t") + 1) | F.array_contains("ys", F.col("t") + 2))
    g = k.groupBy("t").agg(F.sum(gone.cast("int")).alias("absent"), F.sum(F.array_contains("ys", F.col("t")).cast("int")).alias("total"))
    return g.select(F.col("t").alias("year"), "absent", "total", F.round(100.0 * F.col("absent") / F.col("total"), 6).alias("pct"))


def keep_old(old: DataFrame, new: DataFrame, key: list[str], accounts: list[str], date: str, day: Column) -> DataFrame:
    """Old rows with the accounts of the refetched row where that has the same filing date, not after the day; `changed` lists accounts that differ (null counts as 0)."""
    n = new.select(*key, F.col(date).alias("__d"), *[F.col(a).alias(f"__{a}") for a in accounts])
    j = old.join(n, key, "left").withColumn("__ok", F.coalesce((F.col("__d") == F.col(date)) & (F.col("__d") <= day), F.lit(False)))
    changed = F.array_compact(F.array(*[F.when(F.col("__ok") & (F.coalesce(f"__{a}", F.lit(0)) != F.coalesce(a, F.lit(0))), F.lit(a)) for a in accounts]))
    return j.select(*key, date, *[F.when(F.col("__ok"), F.col(f"__{a}")).otherwise(F.col(a)).alias(a) for a in accounts], F.array_join(changed, ",").alias("changed"))


def eta_squared(df: DataFrame, group: str, value: str, by: list[str]) -> DataFrame:
    """Share of a value's variance between groups: null for fewer than 3 values, 2 groups, or no variance. Blank groups are left out."""
    d = df.where(F.col(value).isNotNull() & (F.col(group) != ""))
    g = d.groupBy(*by, group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = g.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean = F.col("s") * F.col("s") / F.col("n")
    total = F.col("q") - mean
    return t.select(*by, "n", "groups", F.when((F.col("n") >= 3) & (F.col("groups") >= 2) & (total > 0), (F.col("b") - mean) / total).alias("eta2"))


def auc(counts: DataFrame, positive: str, score: str, n: str) -> DataFrame:
    """Mann-Whitney U over n1 * n2 with averaged ties, from how often each score occurs: the window sorts a row for each distinct score, so scores must have few decimals."""
    c = counts.groupBy(score).agg(F.sum(F.when(F.col(positive), F.col(n)).otherwise(0)).alias("p"), F.sum(F.when(F.col(positive), 0).otherwise(F.col(n))).alias("q"))
    w = Window.partitionBy(F.lit(1)).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    u = c.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    return u.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), (F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / (F.sum("p").cast("double") * F.sum("q").cast("double"))).alias("auc"))


def bucket_of(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise("21+")
