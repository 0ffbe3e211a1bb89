"""The queries that SQL can express, against DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from hitlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.split('.')[0]} as select * from read_parquet('{SF}/{file}')")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(con.sql(f"SELECT {quoted} FROM ({queries.ORACLE_SQL[name]})").fetchall())
