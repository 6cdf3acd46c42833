"""Every query against its SQL in DuckDB, and the shape of every plan."""

import duckdb
import pytest
from support import plan_of

import __spark_entry__ as driver
from cinefold import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "customer", "part", "events")
QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def sorted_rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(
        (tuple(r) for r in frame.itertuples(index=False)),
        key=lambda r: [(v is not None, str(type(v)), v) for v in r],
    )


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = plan_of(df)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert unwanted not in plan
    made, wanted = df.toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(made.columns) == sorted(wanted.columns)
    assert sorted_rows(made) == sorted_rows(wanted)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
