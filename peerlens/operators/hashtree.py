"""Digests of a table's content as a tree over ranges of hashed keys, so that two versions that differ say where.

A leaf holds the rows whose key's MD5 begins with the same hexadecimal digits; its digest is that of its sorted lines. The digest of a node is that of its children's, at most
16 of them, up to the root. No group grows with the table if the depth does (see depth_for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf, more or less, where the depth follows the table.
LEAF = 10_000


def depth_for(rows: int, leaf: int = LEAF) -> int:
    """The least depth at which leaves have about so many rows; versions that are to be compared need the same one."""
    depth = 0
    while rows > leaf * 16**depth:
        depth += 1
    return depth


def tree(df: DataFrame, key: Column, values: Column, depth: int, by: list[str] | None = None) -> DataFrame:
    """by..., level (0: root), node (the digits its keys begin with), n (rows), digest (SHA-256). key and values: strings of a row."""
    by = by or []
    line = F.concat_ws(":", key, values)
    out = df.select(*by, F.left(F.md5(key.cast("binary")), F.lit(depth)).alias("node"), line.alias("line")).groupBy(*by, "node").agg(F.count("*").alias("n"), F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("line"))), 256).alias("digest"))
    out = level = out.select(*by, F.lit(depth).alias("level"), "node", "n", "digest")
    for d in range(depth - 1, -1, -1):
        children = F.sort_array(F.collect_list(F.concat_ws(":", "node", "digest")))
        level = level.groupBy(*by, F.left("node", F.lit(d)).alias("up")).agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("\n", children), 256).alias("digest"))
        level = level.select(*by, F.lit(d).alias("level"), F.col("up").alias("node"), "n", "digest")
        out = out.unionByName(level)
    return out


def root(df: DataFrame, key: Column, values: Column, depth: int, by: list[str] | None = None) -> DataFrame:
    """by..., digest of the whole."""
    return tree(df, key, values, depth, by).where("level = 0").select(*(by or []), "digest")


def differing(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., level, node, old_n, new_n of the nodes of two trees whose digests differ; leaves among them name the ranges that have changed."""
    on = [*(by or []), "level", "node"]
    j = old.withColumnsRenamed({"n": "old_n", "digest": "was"}).join(new.withColumnsRenamed({"n": "new_n", "digest": "now"}), on, "full")
    return j.where(~F.col("was").eqNullSafe(F.col("now"))).select(*on, F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"))


def tree_sql(name: str, source: str, key: str, values: str, depth: int, by: str = "") -> str:
    """The same for DuckDB: name AS (by..., level, node, n, digest)."""
    by = f"{by}, " if by else ""
    parts = [f"{name}_{depth} AS (SELECT {by}left(md5({key}), {depth}) AS node, count(*) AS n, sha256(string_agg({key} || ':' || {values}, chr(10) ORDER BY {key} || ':' || {values})) AS digest FROM {source} GROUP BY ALL)"]
    parts += [f"{name}_{d} AS (SELECT {by}left(node, {d}) AS node, sum(n)::BIGINT AS n, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node || ':' || digest)) AS digest FROM {name}_{d + 1} GROUP BY {by}left(node, {d}))" for d in range(depth - 1, -1, -1)]
    every = " UNION ALL ".join(f"SELECT {by}{d} AS level, node, n, digest FROM {name}_{d}" for d in range(depth + 1))
    return ", ".join([*parts, f"{name} AS ({every})"])
