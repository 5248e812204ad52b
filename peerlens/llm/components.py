"""Connected components: in one task for few links, by alternating large and small stars for many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, forget, workspace, written


class Sets:
    """Union-find over whatever is met; the smallest member stands for a set."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = Sets()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            sets.join(a, b)
    nodes = np.array(sorted(sets.parent), np.int64)
    roots = np.array([sets.top(x) for x in nodes.tolist()], np.int64)
    own = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(roots[own])], ["node", "root"])


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60, most_in_one_task: int = 500_000) -> DataFrame:
    """node, root (the component's smallest node) of every node that isn't its component's root; from edges a, b (bigint).

    Up to most_in_one_task links (8 MB) go through one executor task, which takes a second where the rounds below take a dozen shuffles; the result is the same.
    With more, each round writes a table and drops the one before. Minima are taken with map-side aggregation, and a node with very many neighbours meets only
    one row (its minimum) in a join, so that such a join can be split.
    """
    at = workspace(spark)
    e = written(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), f"{at}/0")
    if few(e, most_in_one_task):
        return written(spark, e.coalesce(1).mapInArrow(_in_one_task, "node bigint, root bigint"), f"{at}/roots")
    state = None
    for i in range(1, most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        new = written(spark, small, f"{at}/{i}")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        forget(spark, f"{at}/{i - 1}")
        e = new
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
