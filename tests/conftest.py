import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from siftwell.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression built from one row of named values."""

    def value(expression, schema=None, **columns):
        df = spark.createDataFrame([tuple(columns.values())], schema or list(columns)) if columns else spark.range(1)
        got = df.select(expression.alias("x")).head()[0]
        return got.asDict(recursive=True) if hasattr(got, "asDict") else got

    return value


@pytest.fixture
def values(spark):
    """Results of a Column function over many inputs at once, in input order."""

    def run(fn, inputs, schema):
        rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
        df = spark.createDataFrame(rows, "i int, " + schema)
        got = df.select("i", fn().alias("x")).orderBy("i").collect()
        return [r["x"] for r in got]

    return run
