"""Scalar, time and candle functions: plain columns of one bar and the one before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..errors import QueryError
from .registry import INF, Val, constant, divide, function, num, truth, whole


def _num(col, *args) -> Val:
    return Val(col, "num", pending=any(isinstance(a, Val) and a.pending for a in args))


def _bool(col, *args) -> Val:
    return Val(F.coalesce(col, F.lit(False)), "bool", pending=any(isinstance(a, Val) and a.pending for a in args))


def _simple(name, column, text):
    @function(f"{name}(x)", text, "scalar")
    def build(ctx, x):
        return _num(column(num(x)), x)


_simple("abs", F.abs, "absolute value")
_simple("log", lambda x: F.when(x == 0, F.lit(-INF)).when(x > 0, F.ln(x)), "natural logarithm")
_simple("sqrt", lambda x: F.when(x >= 0, F.sqrt(x)), "square root")
_simple("sign", F.signum, "-1, 0 or 1")


@function("round(x, n=0)", "rounded to n decimals, halves to even", "scalar")
def _round(ctx, x, n=None):
    return _num(F.bround(num(x), whole(n) if n else 0), x)


@function("if(cond, then, else)", "one of two values for each row", "scalar")
def _if(ctx, cond, a, b):
    if a.kind != b.kind:
        if "str" in (a.kind, b.kind) or "date" in (a.kind, b.kind):
            raise QueryError("if() cannot mix text with other values", "TypeError")
        a, b = Val(num(a), "num", pending=a.pending), Val(num(b), "num", pending=b.pending)
    return Val(F.when(truth(cond), a.col).otherwise(b.col), a.kind, pending=cond.pending or a.pending or b.pending)


def _part(name, column, text):
    @function(f"{name}()", text, "time")
    def build(ctx):
        return Val(column(ctx.ts), "int")


_part("year", F.year, "calendar year")
_part("quarter", F.quarter, "1 to 4")
_part("month", F.month, "1 to 12")
_part("day_of_month", F.dayofmonth, "1 to 31")
_part("dayofweek", F.weekday, "0 is Monday, 6 is Sunday")
_part("hour", F.hour, "0 to 23")
_part("minute", F.minute, "0 to 59")


@function("date(s?)", "the bar's date, or a date literal", "time")
def _date(ctx, s=None):
    if s is None:
        return Val(F.to_date(ctx.ts), "date")
    if s.kind != "str" or not s.scalar:
        raise QueryError("date() takes a text 'YYYY-MM-DD'", "TypeError")
    day = dt.date.fromisoformat(s.literal)
    return Val(F.lit(day), "date", literal=day)


def prev(ctx, x, n=1):
    x = x if not isinstance(x, Val) else _ready(ctx, x)
    return F.lag(x, n).over(ctx.rows) if n >= 0 else F.lead(x, -n).over(ctx.rows)


def _ready(ctx, v: Val):
    """The number behind a value, after any recursion it waits for has run."""
    if v.pending:
        ctx.flush()
    return num(v)


def _candle(signature, text, kind="num", category="candle"):
    def put(column):
        @function(signature, text, category)
        def build(ctx, *args):
            col = column(ctx, *args)
            return _bool(col, *args) if kind == "bool" else _num(col, *args)

        return column

    return put


def ohlc(ctx):
    return [ctx.get(c) for c in ("open", "high", "low", "close")]


def _price(signature, text, column, kind="num"):
    _candle(signature, text, kind)(lambda ctx: column(*ohlc(ctx)))


_price("range()", "high minus low", lambda o, h, lo, c: h - lo)
_price("range_pct()", "range in percent of low", lambda o, h, lo, c: divide(h - lo, lo) * 100)
_price("midpoint()", "mean of high and low", lambda o, h, lo, c: (h + lo) / 2)
_price("typical_price()", "mean of high, low and close", lambda o, h, lo, c: (h + lo + c) / 3)
_price("body()", "close minus open", lambda o, h, lo, c: c - o)
_price("body_pct()", "body in percent of open", lambda o, h, lo, c: divide(c - o, o) * 100)
_price("upper_wick()", "high minus the higher of open and close", lambda o, h, lo, c: h - F.greatest(o, c))
_price("lower_wick()", "the lower of open and close minus low", lambda o, h, lo, c: F.least(o, c) - lo)
_price("green()", "close above open", lambda o, h, lo, c: c > o, "bool")
_price("red()", "close below open", lambda o, h, lo, c: c < o, "bool")


@_candle("doji(threshold=0.1)", "body smaller than a share of the range", "bool")
def _doji(ctx, threshold=None):
    o, h, lo, c = ohlc(ctx)
    return divide(F.abs(c - o), h - lo) < (constant(threshold) if threshold else 0.1)


@_candle("gap()", "open minus the close before", category="signal")
def _gap(ctx):
    return ctx.get("open") - prev(ctx, ctx.get("close"))


@_candle("gap_pct()", "gap in percent of the close before", category="signal")
def _gap_pct(ctx):
    before = prev(ctx, ctx.get("close"))
    return divide(ctx.get("open") - before, before) * 100


def change(ctx, x, n=None, default=1):
    return _ready(ctx, x) - prev(ctx, x, whole(n) if n else default)


def change_pct(ctx, x, n=None):
    before = prev(ctx, x, whole(n) if n else 1)
    return divide(_ready(ctx, x) - before, before) * 100


_candle("change(col, n=1)", "difference to n bars before", category="signal")(change)
_candle("change_pct(col, n=1)", "difference to n bars before in percent", category="signal")(change_pct)
_candle("roc(col, n=1)", "rate of change in percent", category="signal")(change_pct)
_candle("momentum(col, n=10)", "difference to n bars before", category="signal")(lambda ctx, x, n=None: change(ctx, x, n, 10))


@_candle("inside_bar()", "within the range of the bar before", "bool", "signal")
def _inside(ctx):
    h, lo = ctx.get("high"), ctx.get("low")
    return F.coalesce(h < prev(ctx, h), F.lit(False)) & F.coalesce(lo > prev(ctx, lo), F.lit(False))


@_candle("outside_bar()", "beyond the range of the bar before", "bool", "signal")
def _outside(ctx):
    h, lo = ctx.get("high"), ctx.get("low")
    return F.coalesce(h > prev(ctx, h), F.lit(False)) & F.coalesce(lo < prev(ctx, lo), F.lit(False))


def _cross(name, was, now, text):
    @_candle(f"{name}(a, b)", text, "bool", "signal")
    def build(ctx, a, b):
        x, y = _ready(ctx, a), _ready(ctx, b)
        return F.coalesce(was(prev(ctx, x), prev(ctx, y)), F.lit(False)) & F.coalesce(now(x, y), F.lit(False))


_cross("crossover", lambda a, b: a <= b, lambda a, b: a > b, "a comes above b")
_cross("crossunder", lambda a, b: a >= b, lambda a, b: a < b, "a comes below b")
