"""Every registered query with SQL gives DuckDB's rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from eventloom import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def canon(d: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(d.columns)
    text = lambda x: "null" if x is np.ma.masked else str([text(v) for v in (x.tolist() if isinstance(x, np.ma.MaskedArray) else x)]) if isinstance(x, (list, tuple, np.ndarray)) else "null" if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else f"{x:.5f}" if isinstance(x, (float, np.floating)) else str(x)
    return pd.DataFrame({c: [text(x) for x in d[c]] for c in cols}).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, db, tmp_path, name):
    plans.QUERIES[name](spark, DIR).write.parquet(f"{tmp_path}/out")
    ours, theirs = canon(db.sql(f"select * from '{tmp_path}/out/*.parquet'").df()), canon(db.sql(plans.ORACLES[name]).df())
    pd.testing.assert_frame_equal(ours, theirs)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DIR).count() > 0
