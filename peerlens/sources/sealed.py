"""Sealed parameters in a file, with their SHA-256 in a file beside it. Both go through Spark's file system layer."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

from peerlens.operators.govern import seal, unseal

from .snapshots import _path, exists

DIGEST = ".sha256"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: under another name first, then in the place of what was there."""
    jvm = spark.sparkContext._jvm
    (fs, to), (_, own) = _path(spark, path), _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(own, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(own), fs.makeQualified(to), options)


def get_text(spark: SparkSession, path: str) -> str:
    """A small file's text; read anew each time."""
    fs, p = _path(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def write_sealed(spark: SparkSession, path: str, parameters: Mapping[str, object]) -> str:
    """Freezes parameters once: a sealed file is never written over. Returns the digest."""
    if exists(spark, path) or exists(spark, path + DIGEST):
        raise FileExistsError(path)
    text, digest = seal(parameters)
    put_text(spark, path, text)
    put_text(spark, path + DIGEST, digest)
    return digest


def read_sealed(spark: SparkSession, path: str) -> tuple[dict, str]:
    """The parameters and their digest; ValueError if the file isn't the one that was sealed."""
    digest = get_text(spark, path + DIGEST).strip()
    return unseal(get_text(spark, path), digest), digest
