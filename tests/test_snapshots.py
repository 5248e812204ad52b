"""Caches, phases, swaps and zipped documents in a temporary folder."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerlens.sources import snapshots as N
from peerlens.sources import tables


def test_missing_table_is_empty(spark, tmp_path):
    schema = T.StructType([T.StructField("corp", T.StringType()), T.StructField("as_of", T.IntegerType())])
    assert tables.read_layer(spark, str(tmp_path / "none"), schema, 2020).count() == 0


def test_caches(spark, tmp_path):
    made = []

    def make(d=None):
        made.append(1)
        return spark.range(3) if d is None else d.withColumn("x", F.lit(1))

    for _ in range(2):
        assert N.cached(spark, str(tmp_path / "t"), make).count() == 3
    assert len(made) == 1
    a = spark.createDataFrame([("k", 1), ("l", 2)], "k string, v int")
    for d, version in ((a, "1"), (a.orderBy(F.desc("k")), "1"), (a, "2"), (a.withColumn("v", F.col("v") + 1), "1")):
        assert N.cached_by_content(spark, str(tmp_path / "c"), d, version, make).count() == 2
    assert len(made) == 4


def test_outcomes(spark):
    wanted = spark.createDataFrame([(i,) for i in "abcdea"], "k string")
    kept = spark.createDataFrame([("a", 4)], "k string, size int")
    fetched = spark.createDataFrame([("b", "000", 7), ("c", "013", None), ("d", "020", None), ("a", "000", 9)], "k string, status string, size int")
    got = N.outcomes(wanted, kept, fetched, ["k"])
    assert sorted(map(tuple, got.collect())) == [("a", "hit", 4), ("b", "miss_fetched", 7), ("c", "empty_cached", 0), ("d", "limit", None), ("e", "error", None)]
    assert N.to_keep(got).count() == 3
    sections = N.section_outcomes(wanted, kept, spark.createDataFrame([("b", "ok", 0), ("c", "limit", None)], "k string, status string, size int"), ["k"])
    assert {r.k: (r.outcome, r["size"]) for r in sections.collect()} == {"a": ("hit", 4), "b": ("miss_fetched", 0), "c": ("limit", None), "d": ("error", None), "e": ("error", None)}


def test_phases_go_on_where_they_stopped(spark, tmp_path):
    phases = {"one": lambda t: spark.range(4), "two": lambda t: t["one"].where("id > 1")}
    first = N.build_snapshot(spark, str(tmp_path), {"one": phases["one"]})
    assert [found for _, found in first.values()] == [False]
    again = N.build_snapshot(spark, str(tmp_path), phases)
    assert {k: (t.count(), found) for k, (t, found) in again.items()} == {"one": (4, True), "two": (2, False)}


def test_versions_are_live_whole_or_not_at_all(spark, tmp_path):
    v, names = N.Versions(spark, str(tmp_path)), ["universe", "features"]
    with pytest.raises(FileNotFoundError):
        v.read("features")
    phases = {"universe": lambda t: spark.range(4), "features": lambda t: t["universe"].where("id > 0")}

    def stop(t):
        raise RuntimeError("the run ends here")

    with pytest.raises(RuntimeError):
        v.build("a", {**phases, "features": stop})
    with pytest.raises(ValueError):
        v.publish("a", names)
    (tmp_path / "a" / "features").mkdir()
    (tmp_path / "a" / "features" / "part-0.parquet").write_bytes(b"half")  # what a killed run leaves
    with pytest.raises(ValueError):
        v.publish("a", names)
    assert [found for _, found in v.build("a", phases).values()] == [True, False]
    assert v.publish("a", names)["live"] == "a" and v.read("features").count() == 3
    with pytest.raises(FileExistsError):
        v.build("a", phases)
    v.build("b", {**phases, "universe": lambda t: spark.range(10, 14)})
    assert v.read("universe").agg(F.min("id")).first()[0] == 0  # not before it is published
    with pytest.raises(ValueError):
        v.publish("b", names, same_rows_as="a")  # 4 rows of features, not 3
    v.build("c", {**phases, "universe": lambda t: spark.range(4).select((-F.col("id")).alias("id")), "features": lambda t: t["universe"].where("id < 0")})
    assert v.publish("c", names, same_rows_as="a")["history"] == ["a", "c"] and v.read("universe").agg(F.min("id")).first()[0] == -3
    assert v.back()["live"] == "a" and v.read("universe").agg(F.min("id")).first()[0] == 0
    with pytest.raises(ValueError):
        v.back()
    assert v.publish("c", names)["history"] == ["a", "c"]


def test_zipped_documents(spark, tmp_path):
    for name, body in (("a", "가나".encode()), ("b", "가나".encode("cp949")), ("c", b"ok\xff\xfe\x80")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("x.xml", body)
    (tmp_path / "d.zip").write_bytes(b"no zip")
    got = {r.path[-5]: (r.status, r.text) for r in N.read_zipped(spark, str(tmp_path)).collect()}
    assert got["a"] == got["b"] == ("ok", "가나") and got["c"][0] == "ok" and got["c"][1].startswith("ok") and got["d"] == ("not_zip", None)


def test_spaces_pins_and_allowed_columns(spark):
    v = spark.createDataFrame([(1, 2000), (2, None), (3, None), (4, 1999)], "id int, space int")
    assert sorted((r.year, r.id) for r in N.in_space(v, [2000, 2001]).collect()) == [(2000, 1), (2001, 2), (2001, 3)]
    years = spark.createDataFrame([(2000,), (2001,)], "year int")
    assert N.pinned(years, [None, None]) == 2001 and N.pinned(years, [None, 2000]) == 2000
    with pytest.raises(ValueError):
        N.pinned(years, [1990])
    assert N.allowed(v, ["id"], ["space", "more"], ["cost"]).columns == ["id", "space"]
    with pytest.raises(ValueError):
        N.allowed(v, ["id"], ["cost"], ["cost"])
