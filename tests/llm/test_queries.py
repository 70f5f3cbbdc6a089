"""Queries of this subpackage against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from tramline.llm import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        duck.execute(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    wanted = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert rows and sorted(rows, key=repr) == sorted(wanted, key=repr)
