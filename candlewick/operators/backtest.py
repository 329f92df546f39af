"""Strategy simulation over bars, and performance metrics over its trades.

Signals, targets and the finer bars of each bar are columns made by Spark. The
position itself is a state machine that must see bars in order: a Python task
walks through its symbols' sorted bars batch by batch and keeps one open
position as its only state. The finer bars of a bar follow it as rows of their own,
so a batch holds so many rows however many finer bars a bar has. Metrics are windows and aggregates over trades.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryError
from ..functions import Context
from ..functions.registry import num, truth
from ..plans.expressions import Compiler
from . import timeframes as tf

TIMEFRAMES = ("5m", "15m", "30m", "1h", "2h", "4h", "daily")
LOOKBACK = 200


@dataclass(frozen=True)
class Strategy:
    """What to trade. Levels are points, or text such as "2%" of the entry price."""

    entry: str
    direction: str = "long"
    exit_target: str | None = None
    stop_loss: float | str | None = None
    take_profit: float | str | None = None
    trailing_stop: float | str | None = None
    breakeven_bars: int | None = None
    exit_bars: int | None = None
    slippage: float = 0.0
    commission: float = 0.0


def points(level: float | str, price: float) -> float:
    if isinstance(level, str) and level.endswith("%"):
        return price * float(level.rstrip("%")) / 100
    return float(level)


class Position:
    """An open position: its levels, and what a bar does to them."""

    def __init__(self, strategy: Strategy, at: int, bar: dict, target: float | None):
        s, long = strategy, strategy.direction == "long"
        self.strategy, self.long, self.at, self.bar = s, long, at, bar
        self.price = bar["open"] + (s.slippage if long else -s.slippage)
        side = 1 if long else -1
        self.stop = None if s.stop_loss is None else self.price - side * points(s.stop_loss, self.price)
        self.profit = None if s.take_profit is None else self.price + side * points(s.take_profit, self.price)
        self.target, self.reason, self.even = target, "stop", False
        self.trail = None if s.trailing_stop is None else points(s.trailing_stop, self.price)
        self.best = None if self.trail is None else self.price

    def levels(self, high: float, low: float) -> tuple[float, str] | None:
        """The exit within one bar, the worst first."""
        long, stop, reason = self.long, self.stop, self.reason
        if self.trail is not None:
            self.best = max(self.best, high) if long else min(self.best, low)
            follow = self.best - self.trail if long else self.best + self.trail
            if stop is None or (follow >= stop if long else follow <= stop):
                stop, reason = follow, "trailing_stop"
        if stop is not None and (low <= stop if long else high >= stop):
            return stop, reason
        for level, name in ((self.profit, "take_profit"), (self.target, "target")):
            if level is not None and (high >= level if long else low <= level):
                return level, name
        return None

    def begin(self, i: int, bar: dict) -> None:
        s = self.strategy
        if s.breakeven_bars is not None and not self.even and i > self.at and i - self.at >= s.breakeven_bars:
            if bar["open"] > self.price if self.long else bar["open"] < self.price:
                self.stop, self.reason, self.even = self.price, "breakeven", True

    def end(self, i: int, bar: dict) -> tuple[float, str] | None:
        """The exit at the close of a bar that has not reached a level."""
        if self.strategy.exit_bars is not None and i - self.at >= self.strategy.exit_bars:
            return bar["close"], "timeout"
        if bar["last"] and i > self.at:
            return bar["close"], "end"
        return None

    def trade(self, i: int, bar: dict, price: float, reason: str) -> tuple:
        s = self.strategy
        price += -s.slippage if self.long else s.slippage
        pnl = (price - self.price if self.long else self.price - price) - s.commission
        return (bar["symbol"], self.bar["ts"], round(self.price, 4), bar["ts"], round(price, 4), s.direction, round(pnl, 4), reason, i - self.at)


TRADES = "symbol string, entry_ts timestamp_ntz, entry_price double, exit_ts timestamp_ntz, exit_price double, direction string, pnl double, exit_reason string, bars_held int"
_KINDS = [pa.string(), pa.timestamp("us"), pa.float64(), pa.timestamp("us"), pa.float64(), pa.string(), pa.float64(), pa.string(), pa.int32()]


def _walk(strategy: Strategy):
    names = [x.strip().split()[0] for x in TRADES.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar, i, position, inside, trades = None, -1, None, False, []

        def leave(found: tuple[float, str] | None) -> None:
            nonlocal position
            if found:
                trades.append(position.trade(i, bar, *found))
                position = None

        def close() -> None:
            """The end of the current bar, which stands for itself if nothing finer was inside it."""
            if position is not None and not inside:
                leave(position.levels(bar["high"], bar["low"]))
            if position is not None:
                leave(position.end(i, bar))

        def made() -> pa.RecordBatch:
            columns = list(zip(*trades)) or [()] * len(names)
            trades.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], names)

        for batch in batches:
            heads = np.flatnonzero(~batch.column("finer").to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([-1, *heads], [*heads, batch.num_rows]):
                if a >= 0:
                    if bar is not None:
                        close()
                    before, bar, inside = bar, batch.slice(a, 1).to_pylist()[0], False
                    if before is None or bar["symbol"] != before["symbol"]:
                        i, position = -1, None
                    i += 1
                    if position is None and bar["enter"]:
                        position = Position(strategy, i, bar, bar["target"])
                    if position is not None:
                        position.begin(i, bar)
                if position is None or b - a == 1:
                    continue
                fine = batch.slice(a + 1, b - a - 1)
                # Finer bars of a time that has no bar belong to none.
                same = [pc.equal(fine.column(c), pa.scalar(bar[c], fine.schema.field(c).type)) for c in ("symbol", "ts")]
                fine = fine.filter(pc.and_(*same))
                inside = inside or fine.num_rows > 0
                for high, low in zip(fine.column("high").to_pylist(), fine.column("low").to_pylist()):
                    leave(position.levels(high, low))
                    if position is None:
                        break
            yield made()
        if bar is not None:
            close()
            yield made()

    return run


def _targets(bars: DataFrame, signals: DataFrame, expression: str) -> DataFrame:
    """The target of each signal bar, from that bar and at most LOOKBACK - 1 before: each such slice is a series of its own."""
    wanted = signals.select("symbol", F.col("__n").alias("at"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("__n") - LOOKBACK + 1), F.col("__n"))).alias("__n"))
    slices = wanted.join(bars, ["symbol", "__n"])
    slices = slices.select(F.concat_ws("\x1f", "at", "symbol").alias("symbol"), F.col("symbol").alias("__symbol"), "at", "__n", "ts", "open", "high", "low", "close", "volume")
    ctx = Context(slices)
    value = Compiler(ctx, "exit_target").compile(expression)
    ctx.flush()
    return ctx.df.withColumn("__t", num(value)).filter("__n = at").select(F.col("__symbol").alias("symbol"), F.col("at").alias("__n"), F.col("__t").alias("target"))


def prepare(bars: DataFrame, strategy: Strategy, timeframe: str = "daily", fine: DataFrame | None = None) -> DataFrame:
    """Bars of the timeframe with enter, target and last, and as rows of their own the finer bars inside them (``finer``, at their time ``at``)."""
    if strategy.direction not in ("long", "short"):
        raise QueryError(f"direction must be long or short, not '{strategy.direction}'", step="direction")
    if timeframe not in TIMEFRAMES:
        raise QueryError(f"timeframe must be one of {', '.join(TIMEFRAMES)}", step="timeframe")
    rows = tf.resample(bars, timeframe)
    ctx = Context(rows)
    signal = Compiler(ctx, "entry").compile(strategy.entry)
    ctx.flush()
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = ctx.df.withColumn("__s", truth(signal)).select("symbol", "ts", "open", "high", "low", "close", "volume", "__s")
    rows = rows.withColumns({"__n": F.row_number().over(w), "last": F.lead("ts").over(w).isNull(), "enter": F.coalesce(F.lag("__s").over(w), F.lit(False))})
    if strategy.exit_target is not None:
        targets = _targets(rows, rows.filter("__s"), strategy.exit_target)
        rows = rows.join(targets.withColumn("__n", F.col("__n") + 1), ["symbol", "__n"], "left")
    else:
        rows = rows.withColumn("target", F.lit(None).cast("double"))
    rows = rows.select("symbol", "ts", "open", "high", "low", "close", "enter", "target", "last", F.lit(False).alias("finer"), F.lit(None).cast(fine.schema["ts"].dataType if fine is not None else "timestamp_ntz").alias("at"))
    if fine is None:
        return rows
    # Nulls meet no bar.
    inside = fine.withColumn("__b", tf.bucket(timeframe, F.col("ts"))).filter(F.col("symbol").isNotNull() & F.col("__b").isNotNull())
    nothing = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("open", "close", "enter", "target", "last")}
    inside = inside.select("symbol", F.col("__b").alias("ts"), "high", "low", F.lit(True).alias("finer"), F.col("ts").alias("at")).withColumns(nothing)
    return rows.unionByName(inside)


def simulate(bars: DataFrame, strategy: Strategy, timeframe: str = "daily", fine: DataFrame | None = None) -> DataFrame:
    """The trades of a strategy, one position at a time in each symbol.

    A signal enters at the open of the next bar. ``fine`` are finer bars that
    order what happens inside a bar; without them a stop comes before a profit.
    """
    rows = prepare(bars, strategy, timeframe, fine)
    rows = rows.repartition("symbol").sortWithinPartitions("symbol", "ts", "finer", "at", "high", "low").drop("at")
    trades = rows.mapInArrow(_walk(strategy), TRADES)
    return trades.withColumns({"entry_date": F.to_date("entry_ts"), "exit_date": F.to_date("exit_ts")})


def _order():
    return Window.partitionBy("symbol").orderBy("entry_ts")


def equity(trades: DataFrame) -> DataFrame:
    """Trades with running profit and loss, its peak so far and the distance to it."""
    running = _order().rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumn("__e", F.sum("pnl").over(running))
    out = out.withColumn("__p", F.greatest(F.lit(0.0), F.max("__e").over(running)))
    return out.withColumns({"equity": F.bround("__e", 4), "drawdown": F.bround(F.col("__e") - F.col("__p"), 4)}).drop("__e", "__p")


def metrics(trades: DataFrame) -> DataFrame:
    """Sixteen figures for each symbol; ratios to nothing are infinite."""
    w = _order()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    win = F.col("pnl") > 0
    t = trades.withColumns({"__w": win, "__e": F.sum("pnl").over(running), "__n": F.row_number().over(w)})
    t = t.withColumn("__p", F.greatest(F.lit(0.0), F.max("__e").over(running)))
    t = t.withColumn("__g", F.col("__n") - F.row_number().over(Window.partitionBy("symbol", "__w").orderBy("entry_ts")))
    t = t.withColumn("__run", F.count(F.lit(1)).over(Window.partitionBy("symbol", "__w", "__g")))
    inf = F.lit(float("inf"))
    total, wins = F.count(F.lit(1)), F.count(F.when(F.col("__w"), 1))
    gain = F.coalesce(F.sum(F.when(F.col("__w"), F.col("pnl"))), F.lit(0.0))
    loss = F.coalesce(F.sum(F.when(~F.col("__w"), F.col("pnl"))), F.lit(0.0))
    pnl, deep = F.sum("pnl"), F.max(F.col("__p") - F.col("__e"))
    return t.groupBy("symbol").agg(
        total.alias("total_trades"),
        wins.alias("winning_trades"),
        (total - wins).alias("losing_trades"),
        (wins / total * 100).alias("win_rate"),
        F.when(loss < 0, F.try_divide(gain, -loss)).otherwise(inf).alias("profit_factor"),
        F.coalesce(F.try_divide(gain, wins), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.try_divide(loss, total - wins), F.lit(0.0)).alias("avg_loss"),
        deep.alias("max_drawdown"),
        pnl.alias("total_pnl"),
        (pnl / total).alias("expectancy"),
        F.avg("bars_held").alias("avg_bars_held"),
        F.coalesce(F.max(F.when(F.col("__w"), F.col("__run"))), F.lit(0)).alias("max_consecutive_wins"),
        F.coalesce(F.max(F.when(~F.col("__w"), F.col("__run"))), F.lit(0)).alias("max_consecutive_losses"),
        F.when(deep > 0, F.try_divide(pnl, deep)).otherwise(inf).alias("recovery_factor"),
        gain.alias("gross_profit"),
        loss.alias("gross_loss"),
    )


def by_exit(trades: DataFrame) -> DataFrame:
    """Exit reasons by what they brought."""
    return trades.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("trades"), F.count(F.when(F.col("pnl") > 0, 1)).alias("wins"), F.sum("pnl").alias("pnl")).orderBy(F.col("pnl").desc(), "exit_reason")


def by_year(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.year("entry_ts").alias("year")).agg(F.count(F.lit(1)).alias("trades"), F.count(F.when(F.col("pnl") > 0, 1)).alias("wins"), F.sum("pnl").alias("pnl")).orderBy("year")


def top_share(trades: DataFrame, n: int = 3) -> DataFrame:
    """What the n best trades brought, and their share of all profit and loss."""
    best = trades.orderBy(F.col("pnl").desc(), "symbol", "entry_ts").limit(n).agg(F.sum("pnl").alias("top_pnl"))
    whole = trades.agg(F.sum("pnl").alias("total_pnl"))
    return whole.join(best).withColumn("share", F.try_divide(F.col("top_pnl"), F.abs("total_pnl")) * 100)  # two rows of one


def summary(trades: DataFrame) -> str:
    """Five lines about a few rows of results."""
    rows = metrics(trades).orderBy("symbol").collect()
    out = []
    for r in rows:
        out += [
            f"{r.symbol}: {r.total_trades} trades, {r.win_rate:.1f}% won, profit factor {r.profit_factor:.2f}",
            f"profit and loss {r.total_pnl:.2f}, expectancy {r.expectancy:.2f}, deepest fall {r.max_drawdown:.2f}",
            f"average win {r.avg_win:.2f}, average loss {r.avg_loss:.2f}, recovery factor {r.recovery_factor:.2f}",
            f"longest runs: {r.max_consecutive_wins} wins, {r.max_consecutive_losses} losses; {r.avg_bars_held:.1f} bars held",
        ]
    exits = ", ".join(f"{e.exit_reason} {e.trades} ({e.pnl:.2f})" for e in by_exit(trades).collect())
    return "\n".join([*out, f"exits: {exits}"]) if rows else "No trades"
