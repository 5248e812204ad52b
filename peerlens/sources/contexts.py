"""Tables that Spark keeps between queries: a bounded number of them, known by what they are and by the files they were made from."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import _path


def stamp(spark: SparkSession, paths: list[str]) -> str:
    """A digest of names, lengths and times of all files under the paths; the files themselves aren't read. Folders are listed by Spark."""
    found = []
    for path in paths:
        fs, p = _path(spark, path)
        status = fs.getFileStatus(p)
        if status.isFile():
            found.append((path, 1, status.getLen(), status.getModificationTime()))
        else:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
            found.append((path, *files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()))
    return hashlib.sha256(repr(found).encode()).hexdigest()


class Contexts:
    """At most so many persisted tables; the one not used for longest goes first, and an entry whose files have changed goes at once."""

    def __init__(self, most: int):
        self.most = most
        self.kept: OrderedDict[tuple, tuple[str, DataFrame]] = OrderedDict()

    def get(self, spark: SparkSession, name: tuple, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
        key, now = (spark.sparkContext.applicationId, *name), stamp(spark, sources)
        if key in self.kept and self.kept[key][0] != now:
            self._drop(key)
        if key not in self.kept:
            self.kept[key] = now, make().persist()
            while len(self.kept) > self.most:
                self._drop(next(iter(self.kept)))
        self.kept.move_to_end(key)
        return self.kept[key][1]

    def _drop(self, key: tuple) -> None:
        self.kept.pop(key)[1].unpersist()

    def clear(self) -> None:
        for key in list(self.kept):
            self._drop(key)
