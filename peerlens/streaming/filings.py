"""Filings as a stream: windows over event time, and the latest filing of each firm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(stream: DataFrame, late: str = "1 day", width: str = "30 days") -> DataFrame:
    """Filings (rcept_dt timestamp, firm) for each window of time; rows later than `late` are dropped by the watermark."""
    return stream.withWatermark("rcept_dt", late).groupBy(F.window("rcept_dt", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def latest(stream: DataFrame) -> DataFrame:
    """The latest filing of each firm so far: state is one row for each firm."""
    return stream.groupBy("firm").agg(F.max("rcept_dt").alias("rcept_dt"), F.count("*").alias("n"))
