"""Each query with SQL gives the SQL's rows."""

import os

import duckdb
import pytest

from panelkiln.plans import registry

SF = "/root/testdata/sf0.001"
#: A part of the queries, one or more of each kind; all of them are compared by __spark_entry__'s driver.
NAMES = ["vwap", "ivol", "high_low_spread", "conditional_sort", "contingency", "fama_macbeth", "monthly_returns", "optimize_inverse_variance", "log_return", "cumulative_return", "rolling_median", "atr", "rolling_skew", "zscore", "ts_rank", "cs_quantize", "ewm_mean", "beta", "rsi", "max_dd", "max_min", "amihud", "edge", "rank_signal", "signal_returns", "liquidity_filter", "performance_table", "portfolio_sort", "information_coefficient", "flagship_long_short"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(5) + 0.0
        elif c == "date":
            frame[c] = frame[c].astype(str).str[:10]
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
