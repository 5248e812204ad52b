"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a character class: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: What separates words that consist of ASCII letters, digits and all characters past ASCII.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the named columns (keyword: type it is cast to, "" for none).

    Columns are found by position, so further columns may have any names, even ones that
    differ from the wanted ones by letter case or that occur twice (the first one counts).
    """
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    out = []
    for name, kind in columns.items():
        c = flat[f"c{names.index(name)}"]
        out.append((c.cast(kind) if kind else c).alias(name))
    return flat.select(*out)


def tagged(df: DataFrame, *wanted: str) -> DataFrame:
    """The wanted columns and, as `row_`, the whole row under positional field names; see untagged()."""
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.select(F.struct(*[flat[f"c{i}"] for i in range(len(names))]).alias("row_"), *[flat[f"c{names.index(n)}"].alias(n) for n in wanted])


def untagged(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("row_.*").toDF(*names)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else; the branch for pure ASCII texts is the JVM's fast path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """array<string> of the words between separators; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def workspace(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="peerlens-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        root = f"file://{own}"
    return f"{root.rstrip('/')}/peerlens-{uuid.uuid4().hex}"


#: While a table is written: shuffle files that it took go once it is there, and batches for Python workers are small on both sides of the pipe.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that written() made, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def few(df: DataFrame, most: int) -> bool:
    """Whether df has no more than so many rows; reads no more than that."""
    return df.limit(most + 1).count() <= most


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows with about so many bytes (or list elements) of a column together, so that memory follows neither the rows'
    number nor their length; a row that is longer by itself is a slice of its own."""
    for whole in batches:
        c = whole.column(column)
        lengths = (pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c)).to_numpy(zero_copy_only=False)
        ends, low = np.cumsum(np.nan_to_num(lengths)), 0
        while low < len(whole):
            before = ends[low - 1] if low else 0
            high = min(max(int(np.searchsorted(ends, before + size, side="right")), low + 1), low + rows)
            yield whole.slice(low, high - low)
            low = high


class Recent:
    """What is known of the keys used last: once `most` of them are in the young part, it becomes the old part, which the next one replaces."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that aren't known; the others are in `young` from now on, and so must these be put."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for k in keys.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                out.append(k)
        return out

    def rest(self) -> None:
        """Drops the old part: between tasks a worker holds no more than the young one."""
        self.old = {}


def release() -> None:
    """Gives back what a worker's allocators hold but don't use: workers live on, and the next stage's memory would come on top."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def local_path(uri: str) -> str:
    """The path under which Python finds a shared folder that is mounted everywhere."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: workers map files into memory, so spark.checkpoint.dir must be a mounted folder (file:)")
    return uri
