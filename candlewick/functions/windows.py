"""Lag, rolling, cumulative, pattern, volume and session functions: windows over a symbol's bars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import timeframes
from .registry import Val, divide, function, truth, whole
from .rows import _ready, prev


def full(ctx, x, n, value):
    """A value over the last n rows, if none of them is missing or outside."""
    w = ctx.last(n)
    return F.when(F.count(x).over(w) == n, value(w))


def mean(ctx, x, n):
    return full(ctx, x, n, lambda w: F.avg(x).over(w))


def total(ctx, x, n):
    return full(ctx, x, n, lambda w: F.sum(x).over(w))


def highest(ctx, x, n):
    return full(ctx, x, n, lambda w: F.max(x).over(w))


def lowest(ctx, x, n):
    return full(ctx, x, n, lambda w: F.min(x).over(w))


def weighted(ctx, x, n):
    """Linear weights, the newest bar heaviest; missing if one of the last n is. One frame, whatever n is."""
    values = F.collect_list(x).over(ctx.last(n))
    parts = F.transform(values, lambda v, i: v * (i + 1))
    return full(ctx, x, n, lambda w: F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / (n * (n + 1) / 2))


@function("prev(col, n=1)", "value n bars before", "lag")
def _prev(ctx, x, n=None):
    _ready_any(ctx, x)
    return Val(_shift(ctx, x, whole(n) if n else 1), x.kind)


@function("next(col, n=1)", "value n bars later (looks ahead)", "lag")
def _next(ctx, x, n=None):
    _ready_any(ctx, x)
    return Val(_shift(ctx, x, -(whole(n) if n else 1)), x.kind)


def _ready_any(ctx, v: Val) -> None:
    if v.pending:
        ctx.flush()


def _shift(ctx, x, n):
    return F.lag(x.col, n).over(ctx.rows) if n >= 0 else F.lead(x.col, -n).over(ctx.rows)


def _rolling(name, value, text):
    @function(f"{name}(col, n)", text, "window")
    def build(ctx, x, n):
        return Val(value(ctx, _ready(ctx, x), whole(n)), "num")


_rolling("rolling_mean", mean, "mean of the last n bars")
_rolling("sma", mean, "mean of the last n bars")
_rolling("rolling_sum", total, "sum of the last n bars")
_rolling("rolling_max", highest, "highest of the last n bars")
_rolling("rolling_min", lowest, "lowest of the last n bars")
_rolling("rolling_std", lambda c, x, n: full(c, x, n, lambda w: F.stddev_samp(x).over(w)), "sample deviation of the last n bars")
_rolling("wma", weighted, "linearly weighted mean of the last n bars")


@function("rolling_count(cond, n)", "how often a condition held in the last n bars", "window")
def _rolling_count(ctx, cond, n):
    _ready_any(ctx, cond)
    return Val(total(ctx, truth(cond).cast("int").cast("double"), whole(n)), "num")


@function("hma(col, n)", "Hull mean", "window")
def _hma(ctx, x, n):
    x, n = _ready(ctx, x), whole(n)
    raw = ctx.column(2 * weighted(ctx, x, max(1, n // 2)) - weighted(ctx, x, n))
    return Val(weighted(ctx, raw, max(1, int(n**0.5))), "num")


@function("vwma(n=20)", "volume-weighted mean of close", "window")
def _vwma(ctx, n=None):
    n, c, v = whole(n) if n else 20, ctx.get("close"), ctx.get("volume")
    return Val(divide(total(ctx, c * v, n), total(ctx, v, n)), "num")


@function("ema(col, n)", "exponential mean", "window")
def _ema(ctx, x, n):
    return ctx.kernel("ema", (whole(n),), [x])[0]


@function("rma(col, n)", "Wilder's mean", "window")
def _rma(ctx, x, n):
    return ctx.kernel("rma", (whole(n),), [x])[0]


def _cumulative(name, aggregate, text):
    @function(f"{name}(col)", text, "cumulative")
    def build(ctx, x):
        x = _ready(ctx, x)
        return Val(F.when(x.isNotNull(), aggregate(x).over(ctx.running)), "num")


_cumulative("cummax", F.max, "highest so far")
_cumulative("cummin", F.min, "lowest so far")
_cumulative("cumsum", F.sum, "sum so far")


@function("streak(cond)", "how many bars in a row a condition has held", "pattern")
def _streak(ctx, cond):
    _ready_any(ctx, cond)
    yes = ctx.column(truth(cond).cast("int"), "int")
    run = ctx.column(F.sum(1 - yes).over(ctx.running), "int")
    inside = Window.partitionBy(*ctx.keys, run).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return Val(F.sum(yes).over(inside), "int")


@function("bars_since(cond)", "bars since a condition last held", "pattern")
def _bars_since(ctx, cond):
    _ready_any(ctx, cond)
    n = ctx.column(F.row_number().over(ctx.rows), "int")
    return Val((n - F.last(F.when(truth(cond), n), ignorenulls=True).over(ctx.running)).cast("double"), "num")


@function("valuewhen(cond, col, n=0)", "value at the n-th last time a condition held", "pattern")
def _valuewhen(ctx, cond, x, n=None):
    _ready_any(ctx, cond)
    x, n, yes = _ready(ctx, x), whole(n) if n else 0, truth(cond)
    if n == 0:
        return Val(F.last(F.when(yes, F.struct(x.alias("x"))), ignorenulls=True).over(ctx.running)["x"], "num")
    # Among the rows where the condition held, the value n occurrences before; carried forward to the next one.
    flag = ctx.column(yes, "bool")
    hits = Window.partitionBy(*ctx.keys, flag).orderBy("ts")
    before = ctx.column(F.when(flag, F.struct(F.lag(x, n).over(hits).alias("x"))), "struct")
    return Val(F.last(before, ignorenulls=True).over(ctx.running)["x"], "num")


@function("rank(col)", "share of all values at or below, ties by their mean (looks ahead)", "pattern")
def _rank(ctx, x):
    x = ctx.column(_ready(ctx, x))
    at = F.rank().over(Window.partitionBy(*ctx.keys).orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*ctx.keys, x))
    return Val(F.when(x.isNotNull(), (at + (ties - 1) / 2) / F.count(x).over(ctx.all)), "num")


def _each(name, holds, text):
    @function(f"{name}(col, n=1)", text, "pattern")
    def build(ctx, x, n=None):
        x, out = _ready(ctx, x), F.lit(True)
        for i in range(1, (whole(n) if n else 1) + 1):
            out = out & F.coalesce(holds(x, F.lag(x, i).over(ctx.rows)), F.lit(False))
        return Val(out, "bool")


_each("rising", lambda a, b: a > b, "above each of the n values before")
_each("falling", lambda a, b: a < b, "below each of the n values before")


def _pivot(name, column, extreme, beyond, text):
    @function(f"{name}(n_left=5, n_right=5)", text, "pattern")
    def build(ctx, left=None, right=None):
        left, right = whole(left, "n_left") if left else 5, whole(right, "n_right") if right else 5
        x = ctx.get(column)
        p = F.lag(x, right).over(ctx.rows)
        ok = F.count(x).over(ctx.last(left + right + 1)) == left + right + 1
        for n, a, b in ((left, -(left + right), -(right + 1)), (right, -(right - 1), 0)):
            if n:
                ok = ok & beyond(p, extreme(x).over(ctx.rows.rowsBetween(a, b)))
        return Val(F.when(ok, p), "num")


_pivot("pivothigh", "high", F.max, lambda a, b: a > b, "strict local high, known n_right bars later")
_pivot("pivotlow", "low", F.min, lambda a, b: a < b, "strict local low, known n_right bars later")


@function("obv()", "on-balance volume", "volume")
def _obv(ctx):
    c, v = ctx.get("close"), ctx.get("volume")
    step = v * F.signum(c - prev(ctx, c))
    return Val(F.sum(ctx.column(F.coalesce(step, F.lit(0.0)))).over(ctx.running), "num")


@function("vwap_day()", "volume-weighted typical price since the day began", "volume")
def _vwap(ctx):
    day = Window.partitionBy(*ctx.keys, F.to_date(ctx.ts)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    v = ctx.get("volume")
    tp = (ctx.get("high") + ctx.get("low") + ctx.get("close")) / 3
    return Val(F.when(tp.isNotNull() & v.isNotNull(), divide(F.sum(tp * v).over(day), F.sum(v).over(day))), "num")


@function("ad_line()", "accumulation and distribution", "volume")
def _ad(ctx):
    h, lo, c, v = (ctx.get(x) for x in ("high", "low", "close", "volume"))
    step = F.coalesce(F.when(h != lo, divide((c - lo) - (h - c), h - lo)), F.lit(0.0)) * v
    step = ctx.column(step)
    return Val(F.when(step.isNotNull(), F.sum(step).over(ctx.running)), "num")


@function("volume_ratio(n=20)", "volume over its mean", "volume")
def _volume_ratio(ctx, n=None):
    v = ctx.get("volume")
    return Val(divide(v, mean(ctx, v, whole(n) if n else 20)), "num")


@function("volume_sma(n=20)", "mean volume", "volume")
def _volume_sma(ctx, n=None):
    return Val(mean(ctx, ctx.get("volume"), whole(n) if n else 20), "num")


def _session(name, column, text):
    @function(f"{name}()", text, "session")
    def build(ctx):
        if "__session_id" not in ctx.df.columns:
            ctx.df = timeframes.gap_sessions(ctx.df)
        at = Window.partitionBy(*ctx.keys, "__session_id")
        return Val(column(ctx, at, at.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "num")


_session("session_high", lambda c, w, o: F.max(c.get("high")).over(w), "highest high of the whole session (looks ahead)")
_session("session_low", lambda c, w, o: F.min(c.get("low")).over(w), "lowest low of the whole session (looks ahead)")
_session("session_open", lambda c, w, o: F.first(c.get("open"), ignorenulls=True).over(o), "first open of the session")
_session("session_close", lambda c, w, o: F.last(c.get("close"), ignorenulls=True).over(o), "last close of the whole session (looks ahead)")

