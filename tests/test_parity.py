"""Every query equals its SQL twin on the small tables."""

import pytest

import __spark_entry__ as entry
from compare import difference, oracle, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


def test_every_service_query_has_a_twin():
    from siftwell import workload

    assert sorted(workload.QUERIES) == sorted(workload.SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    assert difference(spark_rows(QUERIES[name](spark, SF)), sql_rows(duck, SQL[name])) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "user_id"
