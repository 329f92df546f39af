"""The simulator on hand-made bars."""

import datetime as dt

import pytest

from candlewick.errors import QueryError
from candlewick.operators import backtest as bt

BARS = [(100, 101, 99, 100, 1), (100, 103, 99, 102, 1), (102, 108, 101, 107, 1), (107, 109, 95, 96, 1), (96, 97, 90, 91, 1), (91, 95, 90, 94, 1)]


def trades(bars, fine=None, timeframe="daily", **options):
    rows = bt.simulate(bars, bt.Strategy(**{"entry": "close == 100", **options}), timeframe, fine).orderBy("entry_ts").collect()
    return [(r.entry_date.day, r.entry_price, r.exit_date.day, r.exit_price, r.pnl, r.exit_reason, r.bars_held) for r in rows]


@pytest.mark.parametrize(
    "options, want",
    [
        ({}, (2, 100, 6, 94, -6, "end", 4)),
        ({"exit_bars": 2}, (2, 100, 4, 96, -4, "timeout", 2)),
        ({"stop_loss": 4}, (2, 100, 4, 96, -4, "stop", 2)),
        ({"stop_loss": "4%", "take_profit": "5%"}, (2, 100, 3, 105, 5, "take_profit", 1)),
        ({"trailing_stop": 10}, (2, 100, 4, 99, -1, "trailing_stop", 2)),
        ({"breakeven_bars": 1, "stop_loss": 50}, (2, 100, 4, 100, 0, "breakeven", 2)),
        ({"exit_target": "high + 5"}, (2, 100, 3, 106, 6, "target", 1)),
        ({"slippage": 1, "commission": 0.5, "exit_bars": 1}, (2, 101, 3, 106, 4.5, "timeout", 1)),
        ({"direction": "short", "take_profit": 5}, (2, 100, 4, 95, 5, "take_profit", 2)),
        ({"direction": "short", "stop_loss": 2}, (2, 100, 2, 102, -2, "stop", 0)),
    ],
)
def test_exits(make_bars, options, want):
    assert trades(make_bars(BARS), **options) == [want]


def test_finer_bars_order_a_bar(make_bars):
    fine = make_bars([(100, 103, 100, 102, 1), (102, 102, 96, 97, 1)], start=dt.datetime(2024, 1, 2, 9), minutes=60)
    assert trades(make_bars(BARS), stop_loss=3, take_profit=2) == [(2, 100, 2, 102, 2, "take_profit", 0)]
    assert trades(make_bars(BARS), fine, stop_loss=3, take_profit=2) == [(2, 100, 2, 102, 2, "take_profit", 0)]
    late = make_bars([(100, 100, 96, 97, 1), (97, 103, 97, 102, 1)], start=dt.datetime(2024, 1, 2, 9), minutes=60)
    assert trades(make_bars(BARS), late, stop_loss=3, take_profit=2) == [(2, 100, 2, 97, -3, "stop", 0)]


def test_finer_bars_are_rows_of_their_own(spark, make_bars):
    """However many finer bars a bar has, a batch of the simulation holds a bounded number of rows of plain values."""
    hours = [(100, 103, 100, 102, 1)] * 9 + [(102, 102, 96, 97, 1), (100, 120, 90, 97, 1)]
    fine = make_bars(hours, start=dt.datetime(2024, 1, 2, 9), minutes=60).unionByName(make_bars([(1, 500, 1, 1, 1)], start=dt.datetime(2024, 1, 9, 9)))
    fine = fine.unionByName(make_bars([(1, 500, 1, 1, 1)], "U", dt.datetime(2024, 1, 2, 9)))
    strategy = bt.Strategy("close == 100", stop_loss=3, take_profit=19)
    rows = bt.prepare(make_bars(BARS), strategy, "daily", fine)
    assert not any(f.dataType.typeName() in ("array", "map", "struct") for f in rows.schema)
    assert rows.count() == len(BARS) + fine.count()
    want = [(2, 100, 2, 97, -3, "stop", 0)]
    assert trades(make_bars(BARS), fine, stop_loss=3, take_profit=19) == want
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for rows in (1, 3):
            spark.conf.set(name, rows)
            assert trades(make_bars(BARS), fine, stop_loss=3, take_profit=19) == want
            assert trades(make_bars(BARS), fine, trailing_stop=12, exit_bars=2) == trades(make_bars(BARS), fine.limit(12), trailing_stop=12, exit_bars=2)
    finally:
        spark.conf.set(name, before)


def test_metrics(make_bars):
    t = bt.simulate(make_bars(BARS), bt.Strategy("close > 0", exit_bars=1))
    m = bt.metrics(t).first()
    assert (m.total_trades, m.winning_trades, m.losing_trades) == (2, 1, 1)
    assert (m.total_pnl, m.max_drawdown, m.gross_profit, m.gross_loss) == (-9, 16, 7, -16)
    assert [r.equity for r in bt.equity(t).orderBy("entry_ts").collect()] == [7, -9]
    assert bt.summary(t).startswith("T: 2 trades")
    assert bt.summary(t.limit(0)) == "No trades"


def test_bad_strategies(make_bars):
    for options in ({"direction": "up"}, {"timeframe": "weekly"}):
        with pytest.raises(QueryError):
            trades(make_bars(BARS), **options)
