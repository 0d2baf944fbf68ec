"""Every registered query of the engine against its SQL."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from specweave.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def normal(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "None"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.6g}" if v != int(v) else str(int(v))
    return str(v)


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(map(tuple, df[cols].map(normal).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLE_SQL:
        assert table(got) == table(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.isdir(DATA)
