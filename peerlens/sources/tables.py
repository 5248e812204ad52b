"""Tables in files: ledgers, layers partitioned by snapshot, append-only checkpoints, report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens.functions.scalar import iso_date

from .snapshots import read_or_empty

LEDGER = T.StructType([T.StructField(c, T.StringType()) for c in ("corp_code", "corp_name", "corp_cls", "stock_code", "rcept_dt", "report_nm")])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A CSV ledger: all strings, a byte order mark is skipped, nulls become "", filing dates are dashed."""
    d = spark.read.schema(LEDGER).option("header", True).csv(path).na.fill("")
    return d.withColumn("rcept_dt", iso_date(F.col("rcept_dt")))


def read_layer(spark: SparkSession, path: str, schema: T.StructType, as_of: int | None = None) -> DataFrame:
    """A layer partitioned by as_of; a year reads its partition only, and a year or a layer that isn't there gives no rows."""
    d = read_or_empty(spark, path, schema)
    return d if as_of is None else d.where(F.col("as_of") == as_of)


def write_layer(df: DataFrame, path: str, amounts: tuple[str, ...] = ()) -> None:
    """Writes a layer by snapshot; amounts as nullable 64-bit integers."""
    df.withColumns({a: F.col(a).cast("bigint") for a in amounts}).write.mode("overwrite").partitionBy("as_of").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, schema: T.StructType, key: str, order: str) -> DataFrame:
    """JSON lines appended over time: the last row of each key wins."""
    d = spark.read.schema(schema).json(path)
    cols = [c for c in d.columns if c != key]
    return d.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def write_report_csv(reports: DataFrame, path: str) -> None:
    """One line for each peer of a report, with a column why_* for each axis of the rationale."""
    flat = reports.select("firm", "as_of", "grade", F.explode("peers").alias("p")).select("firm", "as_of", "grade", "p.rank", "p.peer", "p.sim", "p.why.*")
    why = [f.name for f in reports.schema["peers"].dataType.elementType["why"].dataType.fields]
    flat.select("firm", "as_of", "grade", "rank", "peer", "sim", *[F.col(c).alias(f"why_{c}") for c in why]).write.mode("overwrite").option("header", True).csv(path)


def write_rows_json(df: DataFrame, path: str) -> None:
    """Scores, weights, thresholds: a table as JSON lines."""
    write_report_json(df, path)


def write_report_json(reports: DataFrame, path: str) -> None:
    reports.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
