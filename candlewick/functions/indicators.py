"""Oscillators, volatility and trend indicators: arithmetic around windows and recursions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Val, constant, divide, function, whole
from .rows import _ready, prev
from .windows import full, highest, lowest, mean, total


def _n(v, default: int) -> int:
    return whole(v) if v is not None else default


def _c(v, default: float) -> float:
    return constant(v) if v is not None else default


def _out(col, *args) -> Val:
    return Val(col, "num", pending=any(isinstance(a, Val) and a.pending for a in args))


def rma(ctx, x, n) -> Val:
    return ctx.kernel("rma", (n,), [x])[0]


def ema(ctx, x, n) -> Val:
    return ctx.kernel("ema", (n,), [x])[0]


def true_range(ctx):
    h, lo, before = ctx.get("high"), ctx.get("low"), prev(ctx, ctx.get("close"))
    return F.greatest(h - lo, F.abs(h - before), F.abs(lo - before))


def atr(ctx, n) -> Val:
    return rma(ctx, true_range(ctx), n)


@function("rsi(col, n=14)", "relative strength index", "oscillator")
def _rsi(ctx, x, n=None):
    x, n = _ready(ctx, x), _n(n, 14)
    step = F.coalesce(x - prev(ctx, x), F.lit(0.0))
    up, down = rma(ctx, F.greatest(step, F.lit(0.0)), n), rma(ctx, F.greatest(-step, F.lit(0.0)), n)
    rs = divide(up.col, down.col)
    return _out(F.when(down.col == 0, F.lit(100.0)).otherwise(100 - F.lit(100.0) / (1 + rs)), up, down)


def stochastic(ctx, n):
    hi, lo = highest(ctx, ctx.get("high"), n), lowest(ctx, ctx.get("low"), n)
    return divide(ctx.get("close") - lo, hi - lo) * 100


@function("stoch_k(n=14)", "stochastic %K", "oscillator")
def _stoch_k(ctx, n=None):
    return _out(stochastic(ctx, _n(n, 14)))


@function("stoch_d(n=14, smooth=3)", "stochastic %D", "oscillator")
def _stoch_d(ctx, n=None, smooth=None):
    return _out(mean(ctx, ctx.column(stochastic(ctx, _n(n, 14))), _n(smooth, 3)))


@function("cci(n=20)", "commodity channel index", "oscillator")
def _cci(ctx, n=None):
    n = _n(n, 20)
    tp = ctx.column((ctx.get("high") + ctx.get("low") + ctx.get("close")) / 3)
    middle = ctx.column(mean(ctx, tp, n))
    values = ctx.column(F.collect_list(tp).over(ctx.last(n)), "list")
    away = F.when(middle.isNotNull(), F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - middle)))
    return _out(divide(tp - middle, away / n * 0.015))


@function("williams_r(n=14)", "Williams %R", "oscillator")
def _williams(ctx, n=None):
    n = _n(n, 14)
    hi, lo = highest(ctx, ctx.get("high"), n), lowest(ctx, ctx.get("low"), n)
    return _out(divide(hi - ctx.get("close"), hi - lo) * -100)


@function("mfi(n=14)", "money flow index", "oscillator")
def _mfi(ctx, n=None):
    n = _n(n, 14)
    tp = (ctx.get("high") + ctx.get("low") + ctx.get("close")) / 3
    step, flow = tp - prev(ctx, tp), tp * ctx.get("volume")
    up = ctx.column(F.when(step > 0, flow).otherwise(0.0))
    down = ctx.column(F.when(step < 0, flow).otherwise(0.0))
    gain, loss = total(ctx, up, n), total(ctx, down, n)
    return _out(F.when((loss == 0) & (gain != 0), F.lit(100.0)).otherwise(100 - F.lit(100.0) / (1 + divide(gain, loss))))


@function("tr()", "true range", "volatility")
def _tr(ctx):
    return _out(true_range(ctx))


@function("atr(n=14)", "average true range", "volatility")
def _atr(ctx, n=None):
    return atr(ctx, _n(n, 14))


@function("natr(n=14)", "average true range in percent of close", "volatility")
def _natr(ctx, n=None):
    a = atr(ctx, _n(n, 14))
    return _out(divide(a.col, ctx.get("close")) * 100, a)


def bands(ctx, x, n, mult):
    x, n, mult = _ready(ctx, x), _n(n, 20), _c(mult, 2.0)
    return x, mean(ctx, x, n), full(ctx, x, n, lambda w: F.stddev_pop(x).over(w)) * mult


def _band(name, value, text, args="col, n=20, mult=2.0"):
    @function(f"{name}({args})", text, "volatility")
    def build(ctx, x, n=None, mult=None):
        return _out(value(*bands(ctx, x, n, mult)))


_band("bbands_upper", lambda x, m, s: m + s, "upper Bollinger band")
_band("bbands_middle", lambda x, m, s: m, "middle Bollinger band", "col, n=20")
_band("bbands_lower", lambda x, m, s: m - s, "lower Bollinger band")
_band("bbands_width", lambda x, m, s: divide(2 * s, m) * 100, "width of the Bollinger bands in percent")
_band("bbands_pctb", lambda x, m, s: divide(x - (m - s), 2 * s), "place within the Bollinger bands")


def _keltner(name, value, text, args="n=20, atr_n=10, mult=1.5"):
    @function(f"{name}({args})", text, "volatility")
    def build(ctx, n=None, atr_n=None, mult=None):
        middle, a = ema(ctx, ctx.get("close"), _n(n, 20)), atr(ctx, _n(atr_n, 10))
        return _out(value(middle.col, a.col * _c(mult, 1.5)), middle, a)


_keltner("kc_upper", lambda m, a: m + a, "upper Keltner band")
_keltner("kc_lower", lambda m, a: m - a, "lower Keltner band")
_keltner("kc_width", lambda m, a: divide(2 * a, m), "width of the Keltner bands as a share")


@function("kc_middle(n=20)", "middle Keltner band", "volatility")
def _kc_middle(ctx, n=None):
    return ema(ctx, ctx.get("close"), _n(n, 20))


@function("donchian_upper(n=20)", "highest high", "volatility")
def _donchian_upper(ctx, n=None):
    return _out(highest(ctx, ctx.get("high"), _n(n, 20)))


@function("donchian_lower(n=20)", "lowest low", "volatility")
def _donchian_lower(ctx, n=None):
    return _out(lowest(ctx, ctx.get("low"), _n(n, 20)))


def macd_line(ctx, x, fast, slow) -> Val:
    a, b = ema(ctx, x, _n(fast, 12)), ema(ctx, x, _n(slow, 26))
    return _out(a.col - b.col, a, b)


@function("macd(col, fast=12, slow=26)", "difference of two exponential means", "trend")
def _macd(ctx, x, fast=None, slow=None):
    return macd_line(ctx, x, fast, slow)


@function("macd_signal(col, fast=12, slow=26, sig=9)", "exponential mean of macd", "trend")
def _macd_signal(ctx, x, fast=None, slow=None, sig=None):
    return ema(ctx, macd_line(ctx, x, fast, slow), _n(sig, 9))


@function("macd_hist(col, fast=12, slow=26, sig=9)", "macd minus its signal", "trend")
def _macd_hist(ctx, x, fast=None, slow=None, sig=None):
    line = macd_line(ctx, x, fast, slow)
    signal = ema(ctx, line, _n(sig, 9))
    return _out(line.col - signal.col, line, signal)


def directional(ctx, n):
    h, lo = ctx.get("high"), ctx.get("low")
    up, down = h - prev(ctx, h), prev(ctx, lo) - lo
    plus = F.when((up > down) & (up > 0), up).otherwise(0.0)
    minus = F.when((down > up) & (down > 0), down).otherwise(0.0)
    a, p, m = atr(ctx, n), rma(ctx, plus, n), rma(ctx, minus, n)
    return divide(p.col, a.col) * 100, divide(m.col, a.col) * 100, (a, p, m)


@function("plus_di(n=14)", "positive directional indicator", "trend")
def _plus_di(ctx, n=None):
    p, _, used = directional(ctx, _n(n, 14))
    return _out(p, *used)


@function("minus_di(n=14)", "negative directional indicator", "trend")
def _minus_di(ctx, n=None):
    _, m, used = directional(ctx, _n(n, 14))
    return _out(m, *used)


@function("adx(n=14)", "average directional index", "trend")
def _adx(ctx, n=None):
    n = _n(n, 14)
    p, m, used = directional(ctx, n)
    return rma(ctx, _out(divide(F.abs(p - m), p + m) * 100, *used), n)


def _super(ctx, n, mult):
    a = atr(ctx, _n(n, 10))
    return ctx.kernel("supertrend", (_c(mult, 3.0),), [Val(ctx.get(c), "num") for c in ("high", "low", "close")] + [a])


@function("supertrend(n=10, mult=3.0)", "ratcheting band line", "trend")
def _supertrend(ctx, n=None, mult=None):
    return _super(ctx, n, mult)[0]


@function("supertrend_dir(n=10, mult=3.0)", "1 in an up trend, -1 in a down trend", "trend")
def _supertrend_dir(ctx, n=None, mult=None):
    return _super(ctx, n, mult)[1]


@function("sar(accel=0.02, max_accel=0.2)", "parabolic stop and reverse", "trend")
def _sar(ctx, accel=None, most=None):
    h, lo, c = (ctx.get(x) for x in ("high", "low", "close"))
    return ctx.kernel("sar", (_c(accel, 0.02), _c(most, 0.2)), [h, lo, c, F.lead(c, 1).over(ctx.rows)])[0]
