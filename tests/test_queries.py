"""Every query that has SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from peerlens.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"weight_search_final", "holdout_frozen"} and len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
