"""Long series in slices against the registry's own pass by symbol."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest

from candlewick.errors import QueryError
from candlewick.functions.long_series import BACK, COMPOSED, indicators
from candlewick.functions.registry import REGISTRY
from candlewick.plans.query import run_query
from candlewick.queries_long import QUERIES, SQL
from candlewick.sources.bars import SCHEMA

CALLS = {
    "rolling_mean(close, 7)": ("rolling_mean", "close", 7), "rolling_std(close, 5)": ("rolling_std", "close", 5), "rolling_max(high, 9)": ("rolling_max", "high", 9), "wma(close, 6)": ("wma", "close", 6),
    "hma(close, 9)": ("hma", "close", 9), "vwma(5)": ("vwma", 5), "prev(close, 4)": ("prev", "close", 4), "next(close, 3)": ("next", "close", 3), "change_pct(close, 2)": ("change_pct", "close", 2), "momentum(close)": ("momentum", "close"),
    "rising(close, 2)": ("rising", "close", 2), "crossunder(close, open)": ("crossunder", "close", "open"), "gap_pct()": ("gap_pct",), "inside_bar()": ("inside_bar",), "outside_bar()": ("outside_bar",),
    "pivotlow(3, 2)": ("pivotlow", 3, 2), "pivothigh()": ("pivothigh",), "stoch_k(5)": ("stoch_k", 5), "stoch_d(5, 3)": ("stoch_d", 5, 3), "cci(6)": ("cci", 6), "williams_r(5)": ("williams_r", 5), "mfi(6)": ("mfi", 6), "tr()": ("tr",),
    "bbands_width(close, 8)": ("bbands_width", "close", 8), "bbands_pctb(close, 8)": ("bbands_pctb", "close", 8), "donchian_lower(6)": ("donchian_lower", 6), "volume_ratio(6)": ("volume_ratio", 6), "volume_sma(4)": ("volume_sma", 4),
    "ema(close, 5)": ("ema", "close", 5), "rma(close, 6)": ("rma", "close", 6), "rsi(close, 6)": ("rsi", "close", 6), "atr(5)": ("atr", 5), "natr(5)": ("natr", 5), "macd(close, 3, 8)": ("macd", "close", 3, 8),
    "macd_signal(close, 3, 8, 4)": ("macd_signal", "close", 3, 8, 4), "macd_hist(close, 3, 8, 4)": ("macd_hist", "close", 3, 8, 4), "plus_di(5)": ("plus_di", 5), "minus_di(5)": ("minus_di", 5), "adx(5)": ("adx", 5),
    "kc_upper(6, 4, 1.5)": ("kc_upper", 6, 4, 1.5), "kc_lower(6, 4, 1.5)": ("kc_lower", 6, 4, 1.5), "cumsum(volume)": ("cumsum", "volume"), "cummax(close)": ("cummax", "close"), "cummin(close)": ("cummin", "close"),
    "bars_since(close > open)": ("bars_since", "up"), "streak(close > open)": ("streak", "up"), "valuewhen(close > open, high)": ("valuewhen", "up", "high"), "obv()": ("obv",), "ad_line()": ("ad_line",), "rank(close)": ("rank", "close"),
}


@pytest.fixture(scope="module")
def bars(spark):
    r, rows = random.Random(3), []
    for symbol, n, lost in (("A", 230, 0.0), ("B", 90, 0.06), ("C", 1, 0.0)):
        at, c = dt.datetime(2024, 1, 1), 100.0
        for _ in range(n):
            o, c = c, max(5.0, c + r.gauss(0, 2))
            row = [o, max(o, c) + r.random(), min(o, c) - r.random(), c, float(r.randrange(1, 50))]
            rows.append((symbol, at, *[None if r.random() < lost else x for x in row]))
            at += dt.timedelta(hours=r.choice([1, 1, 5]))
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_every_function_equals_the_pass_by_symbol(bars):
    names = {f"x{i}": text for i, text in enumerate(CALLS)}
    want = run_query({"map": names, "columns": ["symbol", "ts", *names]}, bars, symbols=True).toPandas().sort_values(["symbol", "ts"])
    ups = bars.selectExpr("*", "close > open as up")
    found = indicators(ups, {n: CALLS[t] for n, t in names.items()}, rows=25, n_slices=5).toPandas().sort_values(["symbol", "ts"])
    assert len(want) == len(found) == bars.count()
    for n, text in names.items():
        a, b = want[n].to_numpy(float), found[n].to_numpy(float)
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), text


def test_which_functions_there_are(bars):
    assert set(BACK) | set(COMPOSED) | {"rank"} <= set(REGISTRY)
    with pytest.raises(QueryError):
        indicators(bars, {"x": ("sar",)})


def test_no_row_and_one_slice(bars):
    calls = {"m": ("sma", "close", 3), "e": ("ema", "close", 3), "c": ("cumsum", "close")}
    assert indicators(bars.limit(0), calls).collect() == []
    assert indicators(bars, calls, n_slices=1).count() == bars.count()


@pytest.mark.parametrize("name", ["long_changes", "long_channels", "long_rsi_atr", "long_so_far"])
def test_quotients_by_zero_are_those_of_sql(spark, tmp_path, name):
    """Prices of 0: SQL gives infinities and, for 0 / 0, NaN."""
    r = random.Random(9)
    value = [0.0] * 3 + [r.choice([0.0, 5.0, 7.5, 8.25]) for _ in range(60)] + [0.0] * 20 + [r.uniform(1, 9) for _ in range(20)]
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2), i % 9, t, v) for t in ("a", "b") for i, v in enumerate(value if t == "a" else [3.0] * 20 + value)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted(db.execute(SQL[name]).fetchall(), key=lambda x: x[:2])
    found = sorted((tuple(x) for x in QUERIES[name](spark, str(tmp_path)).collect()), key=lambda x: x[:2])
    assert repr(found) == repr(want)
    assert any(isinstance(v, float) and not math.isfinite(v) for x in want for v in x)
