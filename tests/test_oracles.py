"""Every query with an oracle against DuckDB on the same tables, and the others for rows alone."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OWN = [q for q in QUERIES if q != "pipeline" and not q.startswith("op")]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return str([plain(i) for i in x])
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "~"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    return repr(float(x)) if isinstance(x, (float, np.floating)) else str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [q for q in OWN if q in ORACLES])
def test_same_rows_as_sql(name, spark, sf, duck):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", [q for q in OWN if q not in ORACLES])
def test_some_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
