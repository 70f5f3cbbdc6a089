"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tramline.plans import more_queries, more_sql, sql
from tramline.plans import queries as transit
from tramline.plans import queries as plan

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")
QUERIES, SQL = transit.queries() | more_queries.queries(), sql.oracle_sql() | more_sql.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return connection


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    wanted = duck.execute(SQL[name])
    assert plain(found.collect(), found.columns) == plain(wanted.fetchall(), [c[0] for c in wanted.description])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_walks_of_unserved_stops_are_not_made(spark, monkeypatch):
    """transfers_precedence pairs served stops only: the pairs of all stops grow as their square."""
    seen, made = [], plan.stops.walk_transfers
    monkeypatch.setattr(plan.stops, "walk_transfers", lambda found, radius: seen.append(found.count()) or made(found, radius))
    plan.transfers_precedence(spark, "/root/testdata/sf0.1")
    served = plan.schedule_of(spark, "/root/testdata/sf0.1").stop_times.select("stop_id").distinct().count()
    assert seen == [served] and served < 1000


def test_hops_sort_the_stop_times_once(spark):
    found = plan.connecting_hops(spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
