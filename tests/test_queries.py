"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
PLAIN = [n for n in entry.queries() if n not in ("pipeline",) and not n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    try:
        return round(float(v), 6) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).to_numpy())


@pytest.mark.parametrize("name", PLAIN)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    if (sql := entry.oracle_sql().get(name)) is None:
        assert len(got)
    else:
        assert rows(got) == rows(duck.sql(sql).df())


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["field_id", "index_name"]
