"""The registry's functions over series too long for one task: ticks, or minutes of decades.

``indicators`` takes calls such as ``{"m": ("sma", "close", 20)}``: a function of the registry,
then its arguments, which are names of columns (conditions are columns too) or numbers. They are worked out
in as few passes as their kinds allow:

* what looks a bounded number of rows back or ahead, by sliced windows with halos,
* exponential and Wilder means, and what is made of them, by composed recursions,
* sums, extremes and last values so far, by running values over slices,
* ranks by counts of distinct values.

Results are those of the registry over one sorted pass (recursions to about 1e-9, since
sums are grouped by slice); missing values are treated alike. SuperTrend and the parabolic
stop depend on the rows before in ways that do not compose; they stay one pass a symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryError
from ..operators import slices
from .registry import Context, Val, divide

_n = lambda default: lambda *a: int(a[0] if a else default) - 1
_col_n = lambda default=None: lambda x, *a: int(a[0] if a else default) - 1
_shift = lambda default: lambda x, *a: abs(int(a[0] if a else default))

#: Rows that a function looks back, from its arguments.
BACK: dict[str, Callable[..., int]] = {
    **dict.fromkeys(("rolling_mean", "sma", "rolling_sum", "rolling_max", "rolling_min", "rolling_std", "rolling_count", "wma"), _col_n()),
    **dict.fromkeys(("bbands_upper", "bbands_middle", "bbands_lower", "bbands_width", "bbands_pctb"), _col_n(20)),
    **dict.fromkeys(("vwma", "donchian_upper", "donchian_lower", "volume_ratio", "volume_sma", "cci"), _n(20)),
    **dict.fromkeys(("stoch_k", "williams_r"), _n(14)),
    **dict.fromkeys(("prev", "change", "change_pct", "roc", "rising", "falling"), _shift(1)),
    **dict.fromkeys(("tr", "gap", "gap_pct", "inside_bar", "outside_bar"), lambda *a: 1),
    **dict.fromkeys(("crossover", "crossunder"), lambda a, b: 1),
    **dict.fromkeys(("pivothigh", "pivotlow"), lambda left=5, right=5: int(left) + int(right)),
    "momentum": _shift(10),
    "hma": lambda x, n: int(n) - 1 + max(1, int(n**0.5)) - 1,
    "stoch_d": lambda n=14, smooth=3: int(n) + int(smooth) - 2,
    "mfi": lambda n=14: int(n),
    "next": lambda x, n=1: 0,
}
AHEAD: dict[str, Callable[..., int]] = {"next": _shift(1)}


@dataclass
class Plan:
    """What a call needs from earlier passes, by helper column, and how its value is made of them."""

    bounded: dict[str, tuple] = field(default_factory=dict)
    scans: list[dict[str, tuple]] = field(default_factory=list)  # one for each pass: name -> (recursion, n, column)
    between: list[dict[str, Column]] = field(default_factory=list)  # columns made before each of these passes
    running: dict[str, object] = field(default_factory=dict)
    value: Column | None = None


def _condition(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(False))


def _value(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def _mean(kind: str):
    def plan(h, x, n):
        return Plan(between=[{f"{h}x": _value(x)}], scans=[{f"{h}m": (kind, int(n), f"{h}x")}], value=F.col(f"{h}m"))

    return plan


def _rsi(h, x, n=14, still=100.0):
    """``still``: the value where nothing has moved either way."""
    step = F.coalesce(_value(x) - F.col(f"{h}p"), F.lit(0.0))
    up, down = F.col(f"{h}u"), F.col(f"{h}d")
    return Plan(
        {f"{h}p": ("prev", x, 1)},
        [{f"{h}u": ("rma", n, f"{h}a"), f"{h}d": ("rma", n, f"{h}b")}],
        [{f"{h}a": F.greatest(step, F.lit(0.0)), f"{h}b": F.greatest(-step, F.lit(0.0))}],
        value=F.when((up == 0) & (down == 0), F.lit(float(still))).when(down == 0, F.lit(100.0)).otherwise(100 - F.lit(100.0) / (1 + divide(up, down))),
    )


def _atr(h, n=14):
    return Plan({f"{h}t": ("tr",)}, [{f"{h}m": ("rma", n, f"{h}t")}], [{}], value=F.col(f"{h}m"))


def _natr(h, n=14):
    plan = _atr(h, n)
    plan.value = divide(F.col(f"{h}m"), F.col("close")) * 100
    return plan


def _macd(part: str):
    def plan(h, x, fast=12, slow=26, sig=9):
        out = Plan(between=[{f"{h}x": _value(x)}], scans=[{f"{h}f": ("ema", fast, f"{h}x"), f"{h}s": ("ema", slow, f"{h}x")}])
        line = F.col(f"{h}f") - F.col(f"{h}s")
        if part == "line":
            out.value = line
            return out
        out.between.append({f"{h}l": line})
        out.scans.append({f"{h}g": ("ema", sig, f"{h}l")})
        out.value = F.col(f"{h}g") if part == "signal" else F.col(f"{h}l") - F.col(f"{h}g")
        return out

    return plan


def _directional(part: str):
    def plan(h, n=14):
        up, down = F.col("high") - F.col(f"{h}h"), F.col(f"{h}l") - F.col("low")
        plus = F.when((up > down) & (up > 0), up).otherwise(0.0)
        minus = F.when((down > up) & (down > 0), down).otherwise(0.0)
        out = Plan(
            {f"{h}t": ("tr",), f"{h}h": ("prev", "high", 1), f"{h}l": ("prev", "low", 1)},
            [{f"{h}a": ("rma", n, f"{h}t"), f"{h}p": ("rma", n, f"{h}u"), f"{h}m": ("rma", n, f"{h}d")}],
            [{f"{h}u": plus, f"{h}d": minus}],
        )
        p, m = divide(F.col(f"{h}p"), F.col(f"{h}a")) * 100, divide(F.col(f"{h}m"), F.col(f"{h}a")) * 100
        if part != "adx":
            out.value = p if part == "plus" else m
            return out
        out.between.append({f"{h}x": divide(F.abs(p - m), p + m) * 100})
        out.scans.append({f"{h}g": ("rma", n, f"{h}x")})
        out.value = F.col(f"{h}g")
        return out

    return plan


def _keltner(side: float):
    def plan(h, n=20, atr_n=10, mult=1.5):
        return Plan({f"{h}t": ("tr",)}, [{f"{h}c": ("ema", n, "close"), f"{h}a": ("rma", atr_n, f"{h}t")}], [{}], value=F.col(f"{h}c") + F.col(f"{h}a") * mult * side)

    return plan


def _so_far(kind: str):
    def plan(h, x):
        v = _value(x)
        return Plan(running={f"{h}r": v if kind == "sum" else (kind, v)}, value=F.when(v.isNotNull(), F.col(f"{h}r")).cast("double"))

    return plan


def _bars_since(h, cond):
    hit = ("last", F.when(_condition(cond), F.col("_row")))
    return Plan(running={f"{h}r": hit}, value=(F.col("_row") - F.col(f"{h}r")).cast("double"))


def _streak(h, cond):
    miss = ("last", F.when(~_condition(cond), F.col("_row")))
    return Plan(running={f"{h}r": miss}, value=(F.col("_row") - F.coalesce(f"{h}r", F.lit(0))).cast("long"))


def _valuewhen(h, cond, x):
    hit = ("last", F.when(_condition(cond), F.struct(_value(x).alias("x"))))
    return Plan(running={f"{h}r": hit}, value=F.col(f"{h}r.x"))


def _obv(h):
    return Plan({f"{h}p": ("prev", "close", 1)}, running={f"{h}r": F.coalesce(F.col("volume") * F.signum(F.col("close") - F.col(f"{h}p")), F.lit(0.0))}, value=F.col(f"{h}r").cast("double"))


def _ad_line(h, flat=0.0):
    """``flat``: the share of the volume that a bar without a range adds."""
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    share = F.when(high == low, F.lit(float(flat))).otherwise(divide((close - low) - (high - close), high - low))
    step = F.coalesce(share, F.lit(0.0)) * F.col("volume")
    return Plan(running={f"{h}r": step}, value=F.when(step.isNotNull(), F.col(f"{h}r")).cast("double"))


COMPOSED: dict[str, Callable[..., Plan]] = {
    "ema": _mean("ema"), "rma": _mean("rma"), "rsi": _rsi, "atr": _atr, "natr": _natr,
    "macd": _macd("line"), "macd_signal": _macd("signal"), "macd_hist": _macd("hist"),
    "plus_di": _directional("plus"), "minus_di": _directional("minus"), "adx": _directional("adx"),
    "kc_upper": _keltner(1.0), "kc_lower": _keltner(-1.0),
    "cumsum": _so_far("sum"), "cummax": _so_far("max"), "cummin": _so_far("min"),
    "bars_since": _bars_since, "streak": _streak, "valuewhen": _valuewhen, "obv": _obv, "ad_line": _ad_line,
}


def _reach(table: dict, call: tuple) -> int:
    return table[call[0]](*call[1:]) if call[0] in table else 0


def _bounded(df: DataFrame, keys: Sequence[str], order: Sequence[str], calls: dict[str, tuple], rows: int) -> DataFrame:
    def build(part: DataFrame, by: list[Column]) -> DataFrame:
        ctx = Context(part)
        ctx.rows = Window.partitionBy(*by).orderBy(*order)
        for name, (function, *args) in calls.items():
            given = [ctx.names[a] if isinstance(a, str) else Val(F.lit(a), "num", a) for a in args]
            found = ctx.call(function, given)
            ctx.df = ctx.df.withColumn(name, found.col)
        return ctx.df.select(*slices.columns(part.columns), *slices.columns(list(calls)))

    back, ahead = (max([_reach(table, c) for c in calls.values()], default=0) for table in (BACK, AHEAD))
    return slices.windows(df, keys, order, build, back, ahead, rows)


def indicators(bars: DataFrame, calls: dict[str, tuple], keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), rows: int = slices.ROWS, n_slices: int | None = None) -> DataFrame:
    """``bars`` with one column for each call. ``order`` must place every row of a key; ``rows`` is the length of a slice of windows."""
    keys, order = list(keys), list(order)
    plans: dict[str, Plan] = {}
    bounded = {}
    for i, (name, (function, *args)) in enumerate(calls.items()):
        if function in BACK:
            bounded[name] = (function, *args)
        elif function in COMPOSED:
            plans[name] = COMPOSED[function](f"__h{i}", *args)
            bounded |= plans[name].bounded
        elif function != "rank":
            raise QueryError(f"{function}() is not for long series; use the registry by symbol", "ExpressionError")
    df = _bounded(bars, keys, order, bounded, rows) if bounded else bars
    for level in range(max([len(p.scans) for p in plans.values()], default=0)):
        now = [p for p in plans.values() if len(p.scans) > level]
        df = df.withColumns({n: c for p in now for n, c in p.between[level].items()})
        df = slices.scanned(df, keys, order, {n: s for p in now for n, s in p.scans[level].items()}, n_slices)
    so_far = {n: v for p in plans.values() for n, v in p.running.items()}
    if so_far:
        if any(c[0] in ("bars_since", "streak") for c in calls.values()):
            df = slices.numbered(df, keys, order, "_row", n_slices)
        df = slices.running(df, keys, order, so_far, n_slices)
    df = df.withColumns({name: p.value for name, p in plans.items()})
    for name, (function, *args) in calls.items():
        if function == "rank":
            df = slices.ranked(df, keys, args[0], name, n_slices)
    return df.select(*slices.columns(bars.columns), *slices.columns(list(calls)))
