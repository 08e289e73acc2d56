"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from framewell.plans import bindings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        at = f"{SF}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


def text(v) -> str:
    if v is None or v is pd.NaT or v != v:
        return "~"
    return str(v) if isinstance(v, (bool, str)) or not hasattr(v, "__float__") else f"{float(v) + 0.0:.9g}"


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(bindings.queries()))
def test_query(spark, duck, name):
    got, want = bindings.queries()[name](spark, SF).toPandas(), duck.execute(bindings.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(bindings.queries()) == set(bindings.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(bindings.queries()) <= set(__spark_entry__.queries())
