"""Sessions, periods and timeframes of bars."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryError

INTRADAY = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240}
TIMEFRAMES = (*INTRADAY, "daily", "weekly", "monthly", "quarterly", "yearly")


def is_intraday(timeframe: str) -> bool:
    return timeframe in INTRADAY


def bucket(timeframe: str, ts: Column) -> Column:
    """The label of a timestamp's bucket: its start up to a day, the last day of it above."""
    if timeframe in INTRADAY:
        return F.window(ts, f"{INTRADAY[timeframe]} minutes").start.cast("timestamp_ntz")
    day = F.to_date(ts)
    last = {
        "daily": day,
        "weekly": F.date_add(F.trunc(day, "week"), 6),
        "monthly": F.last_day(day),
        "quarterly": F.last_day(F.add_months(F.trunc(day, "quarter"), 2)),
        "yearly": F.make_date(F.year(day), F.lit(12), F.lit(31)),
    }
    return last[timeframe].cast("timestamp_ntz")


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a longer timeframe: first open, highest high, lowest low, last close, summed volume.

    First and last pass over missing values; a bucket without an open goes. One
    partial and one final aggregation, no sort of the bars.
    """
    if timeframe not in TIMEFRAMES:
        raise QueryError(f"Unknown timeframe: {timeframe}. Valid: {', '.join(TIMEFRAMES)}", step="from")
    if timeframe == "1m":
        return bars
    low = bars.select("symbol", "ts", bucket(timeframe, F.col("ts")).alias("__b"), "open", "high", "low", "close", "volume")
    known = lambda c, by: by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("ts")))
    out = low.groupBy("symbol", "__b").agg(
        known("open", F.min_by).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        known("close", F.max_by).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
    )
    return out.filter(F.col("open").isNotNull()).select("symbol", F.col("__b").alias("ts"), "open", "high", "low", "close", "volume")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def clock(text: str) -> int:
    hour, minute = text.split(":")[:2]
    return int(hour) * 60 + int(minute)


def in_session(ts: Column, start: str, end: str) -> Column:
    """Time of day in [start, end); a session that starts after it ends runs over midnight."""
    a, b, m = clock(start), clock(end), minute_of_day(ts)
    return (m >= a) | (m < b) if a > b else (m >= a) & (m < b)


def has_time_of_day(bars: DataFrame) -> bool:
    """Whether any bar lies outside hour 0 (one row is read from the plan's first match)."""
    return bool(bars.filter(F.hour("ts") != 0).select(F.lit(1)).head(1))


def session_filter(bars: DataFrame, start: str, end: str, check: bool = True) -> DataFrame:
    if check and not has_time_of_day(bars):
        return bars
    return bars.filter(in_session(F.col("ts"), start, end))


def session_tag(bars: DataFrame, start: str, end: str) -> DataFrame:
    """The trading day of each bar: the next date from the start of a session over midnight."""
    day = F.to_date("ts")
    if clock(start) > clock(end):
        day = F.date_add(day, F.when(minute_of_day(F.col("ts")) >= clock(start), 1).otherwise(0))
    return bars.withColumn("__session_id", day)


def gap_sessions(bars: DataFrame, minutes: int = 90) -> DataFrame:
    """Numbers sessions by gaps: a bar more than ``minutes`` after the one before starts a new one."""
    w = Window.partitionBy("symbol").orderBy("ts")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    new = F.when(gap > minutes * 60 * 1_000_000, 1).otherwise(0)
    return bars.withColumn("__new", new).withColumn("__session_id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


_UNIT = re.compile(r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$")
_LAST = re.compile(r"^last_(\d+)$")


def _unit(text: str) -> tuple[dt.datetime, dt.datetime]:
    """A year, month or day as [start, end)."""
    m = _UNIT.match(text)
    try:
        if not m:
            raise ValueError(text)
        year, month, day = int(m[1]), int(m[2] or 1), int(m[3] or 1)
        start = dt.datetime(year, month, day)
    except ValueError:
        raise QueryError(f"Invalid period: '{text}'. Use YYYY, YYYY-MM, YYYY-MM-DD, a range a:b, last_week, last_month, last_year or last_N", step="period", expression=text) from None
    if m[3]:
        return start, start + dt.timedelta(days=1)
    if m[2]:
        return start, start + dt.timedelta(days=calendar.monthrange(year, month)[1])
    return start, dt.datetime(year + 1, 1, 1) if year < 9999 else dt.datetime.max


def period_filter(bars: DataFrame, period: str) -> DataFrame:
    """Bars of a period. Fixed ones are comparisons with literals, which reach the scan."""
    ts = F.col("ts")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    if ":" in period:
        first, _, last = period.partition(":")
        first, last = first.strip(), last.strip()
        if not first and not last:
            raise QueryError(f"Invalid period range: '{period}'", step="period", expression=period)
        if first:
            bars = bars.filter(ts >= at(_unit(first)[0]))
        if last:
            bars = bars.filter(ts < at(_unit(last)[1]))
        return bars
    back = {"last_week": "7 days", "last_month": "1 month", "last_year": "1 year"}.get(period)
    if back:
        end = bars.agg(F.max("ts").alias("__end"))
        return bars.join(F.broadcast(end), ts >= F.expr(f"__end - interval {back}")).drop("__end")  # one row
    m = _LAST.match(period)
    if m:
        n = int(m[1])
        if n < 1:
            raise QueryError(f"Invalid period: '{period}'", step="period", expression=period)
        days = bars.select(F.to_date("ts").alias("__d")).distinct().orderBy(F.col("__d").desc()).limit(n)
        start = days.agg(F.min("__d").cast("timestamp_ntz").alias("__start"))
        return bars.join(F.broadcast(start), ts >= F.col("__start")).drop("__start")  # one row
    a, b = _unit(period)
    return bars.filter((ts >= at(a)) & (ts < at(b)))
