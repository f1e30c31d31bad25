"""Every registered query against its SQL on the smallest driver tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from compare import connection, difference
from tailrace.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLES.items() <= entry_module.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = con.sql(ORACLES[name]).df()
    assert len(want)
    assert difference(got, want) is None, difference(got, want)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.fixture(scope="module")
def hot_folder(tmp_path_factory):
    """The driver tables with a third of all lines on one supplier and on one order, a third of
    all orders on one customer, and a third of all events in one hour of one type."""
    folder = tmp_path_factory.mktemp("hot")
    con = connection(FOLDER)
    hot = {
        "lineitem": "* REPLACE (if(l_linenumber % 3 = 0, 7, l_suppkey) AS l_suppkey,"
        " if(l_partkey % 3 = 0, 11, l_orderkey) AS l_orderkey)",
        "orders": "* REPLACE (if(o_orderkey % 3 = 0, 5, o_custkey) AS o_custkey)",
        "events": "* REPLACE (if(event_id % 3 = 0, TIMESTAMP '2024-01-09 05:10:00', ts) AS ts,"
        " if(event_id % 3 = 0, 'click', event_type) AS event_type)",
    }
    for table in ("region", "nation", "supplier", "customer", *hot):
        columns = hot.get(table, "*")
        con.execute(f"COPY (SELECT {columns} FROM {table}) TO '{folder}/{table}.parquet'")
    return str(folder)


@pytest.mark.parametrize(
    "name", ["balance_wide", "balance_wide_hourly", "regional_cumulative", "minimal_output"]
)
def test_hot_keys_without_broadcasts(spark, hot_folder, name):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        got = entry_module.queries()[name](spark, hot_folder).toPandas()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    tables = ["region", "nation", "supplier", "customer", "lineitem", "orders", "events"]
    want = connection(hot_folder, tables).sql(entry_module.oracle_sql()[name]).df()
    assert len(want)
    assert difference(got, want) is None, difference(got, want)
