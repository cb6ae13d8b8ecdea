"""Every query against its SQL, over whole tables."""

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from glyphlake import queries as Q

SF = f"{DATA}/sf0.001"


def cell(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, duck, name):
    got = Q.queries()[name](spark, SF).toPandas()
    want = duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    assert Q.queries()[name](spark, SF).limit(5).count() >= 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
