"""Every query with SQL against DuckDB on the smallest tables; the others for rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from duochron import queries as base

NAMES = sorted(base.queries())


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, db):
    got = base.queries()[name](spark, sf).toPandas()
    sql = base.oracle_sql().get(name)
    if sql is None:
        # No SQL: what the cells were made with must come out, within a few hundredths of the scaling and a fifth of the rates.
        assert len(got) and {"param", "value", "truth"} <= set(got.columns)
        scaling = got.param.str.startswith(("contrast", "offset"))
        assert (abs(got.value - got.truth)[scaling] < 0.03).all(), got
        loose = got.param.isin(["D0", "D0_ref", "D0_sample", "v0", "f0", "alpha"])
        assert (abs(got.value / got.truth - 1)[loose] < 0.2).all(), got
        assert (scaling | loose | got.param.isin(["D_offset"])).all()
        return
    want = db.execute(sql).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-8, atol=2e-9)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
