"""Every registered detector-hit query against its SQL in DuckDB, at the smallest scale."""

import math
import os
from collections import Counter

import duckdb
import pytest

from hitlake.plans import catalogue

SF = "/root/testdata/sf0.001"
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.split('.')[0]} as select * from read_parquet('{SF}/{file}')")
    return con


def rows(frame, columns):
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else float(v) if hasattr(v, "__float__") and not isinstance(v, (str, bool)) else v
    return Counter(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: KINDS.get(str(t), str(t)) for c, t in zip(want.columns, want.types)} == dict(got.dtypes)
    columns = sorted(got.columns)
    assert rows(got.toPandas(), columns) == rows(want.df(), columns)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_incremental_build_covers_every_capture(spark):
    rows = {r["split"]: r["n"] for r in catalogue.QUERIES["incremental_build"](spark, SF).collect()}
    nc = catalogue.QUERIES["dedup_last_wins"](spark, SF).count()
    assert sum(rows.values()) == nc and set(rows) == {"train", "validation"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
