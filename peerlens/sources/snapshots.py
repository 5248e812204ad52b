"""Tables that are kept between runs: caches with outcomes, snapshots built phase by phase, versions that take each other's place. All paths go through Spark's file system layer."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Answers of the source of statements: rows, none for this kind of statement, the day's limit. Fixed values.
ROWS, NOTHING, LIMIT = "000", "013", "020"
#: Encodings of filings, tried in this order.
ENCODINGS = ("utf-8", "cp949", "euc-kr")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names in spark.checkpoint.dir; only a local session without that setting (tests) gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="peerlens-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        root = f"file://{own}"
    return f"{root.rstrip('/')}/peerlens-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for plans that use it several times; nothing has to be dropped from memory afterwards."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, or no rows of its columns where there is no such path."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under a path, made and written the first time (a half-written one is made again)."""
    if not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_by_content(spark: SparkSession, root: str, source: DataFrame, version: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is made of a table, under a name that follows from its rows (in any order) and a version: other rows or another version are another entry."""
    row = source.agg(F.count("*"), F.sum(F.xxhash64(*source.columns).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *source.columns).cast("decimal(38,0)"))).first()
    name = hashlib.sha256("|".join(map(str, (version, *source.columns, *row))).encode()).hexdigest()
    return cached(spark, f"{root.rstrip('/')}/{name}", lambda: make(source))


def outcomes(wanted: DataFrame, kept: DataFrame, fetched: DataFrame, key: list[str]) -> DataFrame:
    """key, outcome, size of each wanted statement: hit (kept already), miss_fetched (rows came), empty_cached (none exist), limit or error (to be tried again).

    kept: key, size; fetched: key, status, size. Only hits, fetched rows and known absences belong into the cache: see to_keep().
    """
    k = kept.select(*key, F.col("size").alias("had"))
    j = wanted.select(*key).distinct().join(k, key, "left").join(fetched.select(*key, "status", "size"), key, "left")
    new = F.when(F.col("status") == ROWS, "miss_fetched").when(F.col("status") == NOTHING, "empty_cached").when(F.col("status") == LIMIT, "limit").otherwise("error")
    size = F.when(F.col("had").isNotNull(), F.col("had")).when(F.col("status") == ROWS, F.coalesce("size", F.lit(0))).when(F.col("status") == NOTHING, 0)
    return j.select(*key, F.when(F.col("had").isNotNull(), "hit").otherwise(new).alias("outcome"), size.cast("bigint").alias("size"))


def section_outcomes(wanted: DataFrame, kept: DataFrame, fetched: DataFrame, key: list[str]) -> DataFrame:
    """key, outcome, size of each wanted section: as outcomes(), but a section that isn't there is kept as an empty one, and status is ok, limit or error."""
    status = F.when(F.col("status") == "ok", F.lit(ROWS)).when(F.col("status") == "limit", F.lit(LIMIT)).otherwise(F.lit("error"))
    return outcomes(wanted, kept, fetched.withColumn("status", status), key)


def to_keep(found: DataFrame) -> DataFrame:
    """Those outcomes that the cache may hold."""
    return found.where(F.col("outcome").isin("hit", "miss_fetched", "empty_cached"))


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    """path, status, text of zipped documents: the first member, decoded by the first encoding that fits (else without what doesn't). status: ok, or not_zip by the first bytes."""

    def text(raw: bytes) -> tuple[str, str | None]:
        if raw[:2] != b"PK":
            return "not_zip", None
        with zipfile.ZipFile(BytesIO(raw)) as z:
            names = z.namelist()
            body = z.read(names[0]) if names else b""
        for e in ENCODINGS:
            try:
                return "ok", body.decode(e)
            except UnicodeDecodeError:
                pass
        return "ok", body.decode(ENCODINGS[0], "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                status, t = text(b.column("content")[i].as_py())
                yield pa.RecordBatch.from_arrays([b.column("path").slice(i, 1), pa.array([status]), pa.array([t], pa.string())], ["path", "status", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, status string, text string")


def in_space(vectors: DataFrame, years: list[int], space: str = "space") -> DataFrame:
    """year and the vectors of its own space, or of the shared one (a null space) where the year has none; one row for each year is all that is broadcast."""
    y = vectors.sparkSession.createDataFrame([(y,) for y in years], "year int")
    own = vectors.where(F.col(space).isNotNull()).select(F.col(space).alias("year")).distinct().join(F.broadcast(y), "year", "left_semi").withColumn("own", F.lit(True))
    use = y.join(own, "year", "left").select("year", F.when(F.col("own"), F.col("year")).alias("use"))
    return vectors.join(F.broadcast(use), F.col(space).eqNullSafe(F.col("use"))).drop("use")


Phase = Callable[[dict[str, DataFrame]], DataFrame]


def build_snapshot(spark: SparkSession, at: str, phases: dict[str, Phase]) -> dict[str, tuple[DataFrame, bool]]:
    """Tables of a snapshot, one for each phase, each made from those before; a phase whose table is finished is read instead. Returns the tables and whether each was found."""
    done: dict[str, tuple[DataFrame, bool]] = {}
    for name, phase in phases.items():
        path = f"{at.rstrip('/')}/{name}"
        found = finished(spark, path)
        done[name] = cached(spark, path, lambda p=phase: p({k: t for k, (t, _) in done.items()})), found
    return done


#: The small file that names the version of a store that is live, and those before it.
LIVE = "LIVE.json"


class Versions:
    """Versions of a set of tables under one root. A version is a folder that is never written again once it is complete; LIVE names the one that is read.

    Publishing replaces that one small file, so readers see the old version or the new one, whole, whatever becomes of the program that publishes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> dict:
        """live, history (names, oldest first), and rows of each table by version."""
        from .sealed import get_text

        path = f"{self.root}/{LIVE}"
        return json.loads(get_text(self.spark, path)) if exists(self.spark, path) else {"live": None, "history": [], "rows": {}}

    def build(self, name: str, phases: dict[str, Phase]) -> dict[str, tuple[DataFrame, bool]]:
        """Runs a version's phases, going on where a run of the same name stopped (see build_snapshot); nothing is read from it by others before publish()."""
        if name in self.manifest()["history"]:
            raise FileExistsError(f"{name} is published and isn't written again")
        return build_snapshot(self.spark, f"{self.root}/{name}", phases)

    def publish(self, name: str, tables: list[str], same_rows_as: str | None = None) -> dict:
        """Makes a complete version the live one; with same_rows_as only if each table has as many rows as that version's. Returns the manifest."""
        from .sealed import put_text

        missing = [t for t in tables if not finished(self.spark, f"{self.root}/{name}/{t}")]
        if missing:
            raise ValueError(f"{name} isn't complete: {missing}")
        m = self.manifest()
        rows = {t: self.spark.read.parquet(f"{self.root}/{name}/{t}").count() for t in tables}
        before = m["rows"].get(same_rows_as, rows) if same_rows_as else rows
        if before != rows:
            raise ValueError(f"{same_rows_as} has {before} rows, {name} has {rows}")
        m = {"live": name, "history": [*[h for h in m["history"] if h != name], name], "rows": {**m["rows"], name: rows}}
        put_text(self.spark, f"{self.root}/{LIVE}", json.dumps(m, sort_keys=True))
        return m

    def back(self) -> dict:
        """Makes the version before the live one live again; the newer one stays where it is."""
        from .sealed import put_text

        m = self.manifest()
        at = m["history"].index(m["live"])
        if not at:
            raise ValueError("there is no version before this one")
        m["live"] = m["history"][at - 1]
        put_text(self.spark, f"{self.root}/{LIVE}", json.dumps(m, sort_keys=True))
        return m

    def read(self, table: str) -> DataFrame:
        live = self.manifest()["live"]
        if live is None:
            raise FileNotFoundError(f"{self.root} has no live version")
        return self.spark.read.parquet(f"{self.root}/{live}/{table}")


def allowed(df: DataFrame, key: list[str], accounts: list[str], hidden: list[str]) -> DataFrame:
    """df with its key and allowed accounts only; an account that is to be predicted is an error, not a column."""
    wrong = sorted(set(accounts) & set(hidden))
    if wrong:
        raise ValueError(f"scored accounts among the features: {wrong}")
    return df.select(*key, *[c for c in accounts if c in df.columns])


def pinned(found: DataFrame, pins: list[int | None], year: str = "year") -> Column | int:
    """The snapshot to serve: the first pin that is set, which must be a complete year, else the latest one."""
    for pin in pins:
        if pin is not None:
            if found.where(F.col(year) == pin).isEmpty():
                raise ValueError(f"{pin} is no complete snapshot")
            return pin
    return found.agg(F.max(year)).first()[0]
