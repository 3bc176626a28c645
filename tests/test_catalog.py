"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quire.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    clean = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (float, np.floating)) else int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    if name not in catalog.oracle_sql():
        assert len(got)
        return
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
