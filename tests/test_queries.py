"""Every query of the engine against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tickloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(normal(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted(tuple(normal(r[c]) for c in sorted(columns)) for r in df.collect()) == expected


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
