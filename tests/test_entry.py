"""The registry of named queries: they run, and SQL over the same files agrees."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from candlewick import queries as engine

SF = "/root/testdata/sf0.001"
CHECKED = ["weekday_range", "upsert", "resample_weekly", "session_wrap", "period_last_n", "fn_rsi", "fn_adx", "fn_sar", "fn_supertrend", "fn_rank", "fn_valuewhen", "agg_grouped", "steps_three", "bt_metrics", "annotate_events"]


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(engine.oracle_sql()[name]).df()
    got = engine.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    key = [c for c in columns if c in ("ts", "date", "y", "dow", "symbol")] or columns
    a, b = (x[columns].astype({c: str for c in key}).sort_values(key, ignore_index=True) for x in (got, want))
    for c in columns:
        x, y = a[c].tolist(), b[c].tolist()
        assert all(p == q or (p != p and q != q) or (p is None and q != q) or abs(float(p) - float(q)) < 2e-4 for p, q in zip(x, y)), c
