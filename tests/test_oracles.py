"""Every query that SQL can express gives what its DuckDB twin gives."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from framegate.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def told(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = ([None if pd.isna(v) else round(float(v), 5) if isinstance(v, numbers.Number) else v for v in r] for r in df.itertuples(index=False))
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF).toPandas()
    twin = duck.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(twin.columns)
    assert len(ours) and told(ours) == told(twin)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_a_twin_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
