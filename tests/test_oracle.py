"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from scriptorium.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if v is None or (not isinstance(v, (list, dict, np.ndarray)) and pd.isna(v)):
        return "NULL"
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.6f}"
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    return str(v)


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE:
        want = con.execute(registry.ORACLE[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
