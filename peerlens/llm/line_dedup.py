"""Line dedup: lines that several documents share stay in the first of them only.

Spark counts line hashes; the distinct ones go into shards, each a minimal perfect hash with compact arrays of
fingerprints, document counts and first documents. Documents probe the arrays, which workers map into memory; lines are never joined.
A line is known by 128 bits: 64 choose the slot, the other 64 are the fingerprint kept there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mapped, mph
from .common import ascii_lower, local_path, pick, slices, workspace, written

STRIP = " \t\n\x0b\f\r"


def line_hashes(text: Column, min_chars: int) -> Column:
    """array<struct<a, b>> of 64-bit hashes for the lines of a text; null for lines whose key is shorter than min_chars."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ascii_lower(F.btrim(x, F.lit(STRIP))))
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """a, b, n_docs, first_doc of every key. Each row counts a key once; 1 stands for rows of a single document, however many they are (rows without a doc_id are one, which is never the first)."""
    hashed = docs.select("doc_id", F.explode(F.array_distinct(F.array_compact(line_hashes(F.col("text"), min_chars)))).alias("h"))
    counted = hashed.groupBy("h.a", "h.b").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("doc_id").alias("named"))
    shared = F.expr("first_doc < last_doc or 0 < named and named < n")
    return counted.select("a", "b", F.when(shared, F.col("n")).otherwise(1).alias("n_docs"), F.coalesce("first_doc", F.lit(0)).alias("first_doc"))


def build_shards(lines: DataFrame, folder: str, keys_a_shard: int) -> np.ndarray:
    """Writes the shards' files, each of about so many keys, and returns for each shard whether it has any."""
    count = lines.count()
    shards = -(-count // keys_a_shard)
    path = local_path(folder)

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a = rows["a"].to_numpy(np.int64).view(np.uint64)
        index = mph.build(a)
        order = mph.slots(index, a)
        put = lambda name, kind: _placed(rows[name].to_numpy(), order, kind)
        mapped.save(f"{path}/{key[0]}", index | {"fingerprints": put("b", np.int64), "counts": put("n_docs", np.min_scalar_type(int(rows["n_docs"].max()))), "first": put("first_doc", np.int64)})
        return pd.DataFrame({"shard": [key[0]], "n": [len(rows)]})

    if shards:
        made = lines.groupBy(F.pmod("a", F.lit(shards)).alias("shard")).applyInPandas(make, "shard bigint, n bigint").select("shard").collect()  # a number for each shard
    full = np.zeros(shards, bool)
    full[[r[0] for r in made] if shards else []] = True
    return full


def _placed(values: np.ndarray, slots: np.ndarray, kind: type) -> np.ndarray:
    out = np.empty(len(values), kind)
    out[slots] = values
    return out


def probe(path: str, full: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First document and number of documents of each line; 0 documents where the line isn't known."""
    first, count = np.zeros(len(a), np.int64), np.zeros(len(a), np.uint64)
    if not len(full) or not len(a):
        return first, count
    shard = np.mod(a, len(full))
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0, True])
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        own = order[i:j]
        if not full[shard[own[0]]]:
            continue
        index = mapped.load(f"{path}/{shard[own[0]]}")
        slot = mph.slots(index, a[own].view(np.uint64))
        hit = slot >= 0
        hit[hit] = index["fingerprints"][slot[hit]] == b[own][hit]
        first[own[hit]], count[own[hit]] = index["first"][slot[hit]], index["counts"][slot[hit]]
    return first, count


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 10, keys_a_shard: int = 1_000_000, extra: tuple[str, ...] = ()) -> DataFrame:
    """Drops lines whose key at least two documents hold, except from the document with the smallest doc_id that holds it.

    The key of a line is the line without white space at both ends, A-Z lower-cased; keys under min_chars code points always stay.
    Returns doc_id, n_lines, n_dropped, text (lines left, joined by newline) and the columns `extra`.
    A null or empty text is one empty line, and gives an empty text. Rows with the same doc_id count as one document: a line that
    only they hold stays in all of them. Rows without a doc_id count as one document that comes last. A document
    of which nothing is left keeps its row with an empty text. Empty tables are allowed; further columns are ignored. Texts are split whole, however long; a worker
    takes a few MB of lines at once. doc_ids are numbers (or text of digits, which is cast): first documents are compared by number.
    """
    docs = pick(docs, doc_id="bigint", text="string", **dict.fromkeys(extra, ""))
    at = workspace(spark)
    full = build_shards(written(spark, distinct_lines(docs, min_chars), f"{at}/lines"), f"{at}/shards", keys_a_shard)
    path = local_path(f"{at}/shards")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2000, 8 << 20):
            texts, lists = batch.column("text"), batch.column("h")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            a, b = (pc.struct_field(flat.filter(pa.array(known)), [i]).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            docs_of, nameless = (np.repeat(x.to_numpy(zero_copy_only=False), n)[known] for x in (pc.fill_null(batch.column("doc_id"), 0), batch.column("doc_id").is_null()))
            first, count = probe(path, full, a, b)
            gone = np.zeros(len(flat), bool)
            gone[known] = (count > 1) & (nameless | (first != docs_of))
            ends = np.cumsum(n)
            total = np.r_[0, np.cumsum(gone)]
            dropped = total[ends] - total[ends - n]
            if dropped.any():
                out = texts.to_pylist()
                for i in np.flatnonzero(dropped).tolist():
                    lines, bad = out[i].split("\n"), gone[ends[i] - n[i] : ends[i]].tolist()
                    out[i] = "\n".join([x for x, g in zip(lines, bad, strict=True) if not g])
                texts = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(dropped.astype(np.int64)), texts, *[batch.column(c) for c in extra]], ["doc_id", "n_lines", "n_dropped", "text", *extra])

    hashed = docs.withColumns({"text": F.coalesce("text", F.lit("")), "h": line_hashes(F.col("text"), min_chars)})
    kinds = ", ".join(["doc_id bigint, n_lines bigint, n_dropped bigint, text string", *[f"`{c}` {hashed.schema[c].dataType.simpleString()}" for c in extra]])
    return hashed.mapInArrow(drop, kinds)
