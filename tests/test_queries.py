"""Every query with SQL against DuckDB on the smallest tables; the rest must run."""

import duckdb
import pandas as pd
import pytest

from kernelweave.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    cell = lambda v: None if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return [list(df.columns), sorted([tuple(map(cell, r)) for r in df.itertuples(index=False)], key=str)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
