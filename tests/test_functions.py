"""Functions against plain Python and pandas, with missing values and edges."""

import math

import numpy as np
import pandas as pd
import pytest

from candlewick.errors import QueryError
from candlewick.functions import REGISTRY
from candlewick.functions.kernels import Ema, Rma, Sar, Supertrend
from candlewick.plans.query import run_query


def column(bars, text):
    return [r.x for r in run_query({"map": {"x": text}, "columns": ["ts", "x"]}, bars).orderBy("ts").collect()]


def closes(make_bars, values, **options):
    return make_bars([(v, v, v, v, 10) for v in values], **options)


def test_registry_is_complete():
    assert len(REGISTRY) == 109
    assert all(f.signature.startswith(name + "(") and f.description for name, f in REGISTRY.items())


def test_recursions_match_pandas():
    x = np.array([math.nan, 1, math.nan, 3, 5, 4, math.nan, 8])
    want = pd.Series(x).ewm(span=3, adjust=False).mean()
    np.testing.assert_allclose(Ema(3)(x)[0], want)
    got = Rma(3)(x)[0]
    assert np.isnan(got[:4]).all() and got[4] == 3
    np.testing.assert_allclose(got[5:], [3 * 2 / 3 + 4 / 3, 3 * 2 / 3 + 4 / 3, (3 * 2 / 3 + 4 / 3) * 2 / 3 + 8 / 3])
    assert all(math.isnan(v) for v in Rma(9)(x)[0])


def test_recursions_go_on_over_batches():
    rng = np.random.default_rng(3)
    close = 100 + rng.normal(0, 1, 60).cumsum()
    high, low, atr = close + 1, close - 1, np.full(60, 1.5)
    following = np.append(close[1:], math.nan)
    for make, arrays in ((lambda: Ema(5), (close,)), (lambda: Rma(5), (close,)), (lambda: Supertrend(2.0), (high, low, close, atr)), (lambda: Sar(0.02, 0.2), (high, low, close, following))):
        whole = make()(*arrays)
        parts, pieces = make(), []
        for a, b in ((0, 1), (1, 2), (2, 30), (30, 60)):
            pieces.append(parts(*[x[a:b] for x in arrays]))
        joined = [sum((p[k] for p in pieces), []) for k in range(len(whole))]
        np.testing.assert_allclose(joined, whole)


def test_rolling_needs_full_windows(make_bars):
    bars = closes(make_bars, [1, 2, None, 4, 5, 6])
    assert column(bars, "rolling_mean(close, 2)") == [None, 1.5, None, None, 4.5, 5.5]
    assert column(bars, "cumsum(close)") == [1, 3, None, 7, 12, 18]
    assert column(bars, "cummax(close)") == [1, 2, None, 4, 5, 6]


def test_missing_values_in_conditions(make_bars):
    bars = closes(make_bars, [1, 2, None, 4])
    assert column(bars, "close > prev(close)") == [False, True, False, False]
    assert column(bars, "not (close > prev(close))") == [True, False, True, True]
    assert column(bars, "close != 2") == [True, False, True, True]
    assert column(bars, "close in [1, 4]") == [True, False, False, True]
    assert column(bars, "close not in [1, 4]") == [False, True, True, False]


def test_division_and_remainders(make_bars):
    bars = closes(make_bars, [-7, 7, 0])
    assert column(bars, "close / 0") == [-math.inf, math.inf, None]
    assert column(bars, "close % 3") == [2, 1, 0]
    assert column(bars, "close // 2") == [-4, 3, 0]
    assert column(bars, "log(close)") == [None, math.log(7), -math.inf]


def test_patterns(make_bars):
    bars = closes(make_bars, [1, 2, 3, 2, 2, 5])
    assert column(bars, "streak(close > prev(close))") == [0, 1, 2, 0, 0, 1]
    assert column(bars, "bars_since(close == 2)") == [None, 0, 1, 0, 0, 1]
    assert column(bars, "valuewhen(close == 2, volume * close)") == [None, 20, 20, 20, 20, 20]
    assert column(bars, "valuewhen(close >= 2, close, 1)") == [None, None, 2, 3, 2, 2]
    assert column(bars, "rank(close)") == [1 / 6, 3 / 6, 5 / 6, 3 / 6, 3 / 6, 1]
    assert column(bars, "pivothigh(1, 1)") == [None, None, None, 3, None, None]


def test_rsi_starts_at_its_length_and_knows_no_loss(make_bars):
    got = column(closes(make_bars, range(1, 8)), "rsi(close, 3)")
    assert got == [None, None, 100, 100, 100, 100, 100]


def test_symbols_do_not_mix(make_bars):
    a, b = closes(make_bars, [1, 2, 3], symbol="A"), closes(make_bars, [10, 20, 30], symbol="B")
    rows = run_query({"map": {"x": "prev(close)", "e": "ema(close, 1)", "m": "max(close)"}}, a.union(b), symbols=True).collect()
    assert sorted((r.symbol, r.x, r.e, r.m) for r in rows if r.x is None) == [("A", None, 1, 3), ("B", None, 10, 30)]
    assert {(r.symbol, r.close, r.e) for r in rows} == {("A", 1, 1), ("A", 2, 2), ("A", 3, 3), ("B", 10, 10), ("B", 20, 20), ("B", 30, 30)}


def test_empty_and_single_bars(make_bars):
    for n in (0, 1):
        bars = closes(make_bars, [5] * n)
        for text in ("adx()", "sar()", "supertrend()", "macd_hist(close)", "hma(close, 4)", "session_high()", "streak(close > open)"):
            assert len(column(bars, text)) == n


@pytest.mark.parametrize("text, kind", [("nothing(close)", "UnknownFunction"), ("sma(close)", "TypeError"), ("close = 1", "ParseError"), ("close ** 2", "ExpressionError"), ("nope + 1", "ExpressionError"), ("close.abs()", "ExpressionError"), ("sma(close, 2.5)", "TypeError")])
def test_bad_expressions(make_bars, text, kind):
    with pytest.raises(QueryError):
        run_query({"map": {"x": text}}, closes(make_bars, [1]))
