"""Named queries of the engine over the test tables, with the SQL to check them.

Bars come from orders (daily) and events (intraday). Numbers are rounded on
both sides, dates are dates and times are text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_long
from .functions import REGISTRY
from .functions.long_series import indicators
from .operators import backtest as bt
from .operators import joins, rollups
from .operators import market_calendar as cal
from .operators import timeframes as tf
from .plans import response
from .plans.query import plan, run_query
from .sources import bars as src
from .sources import instruments as ins
from .sources import versions
from .sources.shared import pin, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAILY = (
    "SELECT 'ALL' AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, "
    "arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY o_orderdate"
)
DAILY_MULTI = DAILY.replace("'ALL' AS symbol", "o_orderpriority AS symbol") + ", o_orderpriority"


def intraday_sql(minutes: int, by_type: bool = False) -> str:
    symbol = "event_type" if by_type else "'ALL'"
    return (
        f"SELECT {symbol} AS symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, "
        f"arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL".replace("GROUP BY ALL", f"GROUP BY time_bucket(INTERVAL '{minutes} minutes', ts)" + (", event_type" if by_type else ""))
    )


def daily(spark, d):
    return src.order_bars(spark, d)


def hourly(spark, d):
    return src.event_bars(spark, d, 60)


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def shown(df: DataFrame, places: int = 4) -> DataFrame:
    """Columns as both sides give them."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if f.name == "ts":
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm").alias("ts"))
        elif kind == "double":
            finite = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.round(c, places))
            out.append((finite + F.lit(0.0)).alias(f.name))
        elif kind == "integer":
            out.append(c.cast("long").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def ask(name: str, query: dict, bars, sql: str | None = None, places: int = 4, **options) -> None:
    add(name, lambda spark, d: shown(run_query(query, bars(spark, d), **options), places), sql)


TS = "strftime(ts, '%Y-%m-%d %H:%M') AS ts"


def rnd(x: str, places: int = 4) -> str:
    return f"round({x}, {places}) + 0.0"


# Flagship

ask(
    "weekday_range",
    {"from": "daily", "map": {"r": "range()", "dow": "dayofweek()"}, "group_by": "dow", "select": "mean(r)", "sort": "dow asc"},
    daily,
    f"WITH bars AS ({DAILY}) SELECT CAST((dayofweek(ts) + 6) % 7 AS BIGINT) AS dow, {rnd('avg(high - low)')} AS mean_r FROM bars GROUP BY 1",
)

# Sources

add("scan_bars", lambda s, d: shown(daily(s, d).drop("symbol")), f"WITH bars AS ({DAILY}) SELECT {TS}, open, high, low, close, volume FROM bars")
add("scan_bars_multi", lambda s, d: shown(src.order_bars(s, d, True)), f"WITH bars AS ({DAILY_MULTI}) SELECT symbol, {TS}, open, high, low, close, volume FROM bars")
add("ohlc_json", lambda s, d: src.ohlc_json(daily(s, d)),
    f"WITH bars AS ({DAILY}) SELECT '{{\"date\":\"' || strftime(ts, '%Y-%m-%d') || '\",\"open\":' || open || ',\"high\":' || high || ',\"low\":' || low || ',\"close\":' || close || ',\"volume\":' || CAST(volume AS BIGINT) || '}}' AS value FROM bars")


def _upsert(spark, d):
    """Last year's bars come again with doubled volume."""
    bars = daily(spark, d)
    new = bars.filter("ts >= timestamp_ntz'2001-01-01'").withColumn("volume", F.col("volume") * 2)
    return shown(src.upsert(bars, new).drop("symbol"))


add("upsert", _upsert, f"WITH bars AS ({DAILY}) SELECT {TS}, open, high, low, close, volume * CASE WHEN ts >= TIMESTAMP '2001-01-01' THEN 2 ELSE 1 END AS volume FROM bars")



def _versioned(version: int | None = None):
    """Bars by priority as a versioned table; last year's come again with doubled volume, and that batch twice."""

    def query(spark, d):
        root, by_priority = shared_path(spark, "bars"), src.order_bars(spark, d, True)
        versions.merge(spark, root, by_priority, ("days", 0))
        again = by_priority.filter("ts >= timestamp_ntz'2001-01-01'").withColumn("volume", F.col("volume") * 2)
        for _ in range(2):
            versions.merge(spark, root, again, ("days", 1), {"days": "2001"})
        return shown(versions.read(spark, root, version=version))

    return query


add("versioned_upsert", _versioned(), f"WITH bars AS ({DAILY_MULTI}) SELECT symbol, {TS}, open, high, low, close, volume * CASE WHEN ts >= TIMESTAMP '2001-01-01' THEN 2 ELSE 1 END AS volume FROM bars")
add("versioned_before", _versioned(1), f"WITH bars AS ({DAILY_MULTI}) SELECT symbol, {TS}, open, high, low, close, volume FROM bars")

# Timeframes

BUCKETS = {
    "daily": "date_trunc('day', ts)",
    "weekly": "date_trunc('week', ts) + INTERVAL 6 DAY",
    "monthly": "last_day(ts)",
    "quarterly": "date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY",
    "yearly": "make_timestamp(year(ts), 12, 31, 0, 0, 0.0)",
}


def resampled_sql(base: str, bucket: str) -> str:
    return (
        f"WITH bars AS ({base}) SELECT strftime(CAST({bucket} AS TIMESTAMP), '%Y-%m-%d %H:%M') AS ts, {rnd('arg_min(open, ts)')} AS open, {rnd('max(high)')} AS high, "
        f"{rnd('min(low)')} AS low, {rnd('arg_max(close, ts)')} AS close, {rnd('sum(volume)')} AS volume FROM bars GROUP BY {bucket}"
    )


for _name, _minutes in tf.INTRADAY.items():
    ask(f"resample_{_name}", {"from": _name}, lambda s, d: src.event_bars(s, d, 1), resampled_sql(intraday_sql(1), f"time_bucket(INTERVAL '{_minutes} minutes', ts)"))
for _name, _bucket in BUCKETS.items():
    ask(f"resample_{_name}", {"from": _name}, hourly if _name == "daily" else daily, resampled_sql(intraday_sql(60) if _name == "daily" else DAILY, _bucket))

SESSIONS = {"RTH": ("09:30", "16:00"), "ETH": ("18:00", "17:00")}
PLAIN = f"{TS}, {rnd('open')} AS open, {rnd('high')} AS high, {rnd('low')} AS low, {rnd('close')} AS close, volume"
MINUTE = "(hour(ts) * 60 + minute(ts))"
ask("session_regular", {"session": "RTH"}, hourly, f"WITH bars AS ({intraday_sql(60)}) SELECT {PLAIN} FROM bars WHERE {MINUTE} >= 570 AND {MINUTE} < 960", sessions=SESSIONS)
ask("session_wrap", {"session": "eth"}, hourly, f"WITH bars AS ({intraday_sql(60)}) SELECT {PLAIN} FROM bars WHERE {MINUTE} >= 1080 OR {MINUTE} < 1020", sessions=SESSIONS)

PERIODS = {
    "year": ("2000", "ts >= TIMESTAMP '2000-01-01' AND ts < TIMESTAMP '2001-01-01'"),
    "month": ("2000-02", "ts >= TIMESTAMP '2000-02-01' AND ts < TIMESTAMP '2000-03-01'"),
    "day": ("2000-02-03", "ts >= TIMESTAMP '2000-02-03' AND ts < TIMESTAMP '2000-02-04'"),
    "range": ("1999-11:2000", "ts >= TIMESTAMP '1999-11-01' AND ts < TIMESTAMP '2001-01-01'"),
    "open_start": (":1995-06", "ts < TIMESTAMP '1995-07-01'"),
    "open_end": ("2001-05-02:", "ts >= TIMESTAMP '2001-05-02'"),
    "last_week": ("last_week", "ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM bars)"),
    "last_month": ("last_month", "ts >= (SELECT max(ts) - INTERVAL 1 MONTH FROM bars)"),
    "last_year": ("last_year", "ts >= (SELECT max(ts) - INTERVAL 1 YEAR FROM bars)"),
    "last_n": ("last_20", "CAST(ts AS DATE) >= (SELECT min(d) FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM bars ORDER BY d DESC LIMIT 20))"),
}
for _name, (_period, _test) in PERIODS.items():
    ask(f"period_{_name}", {"period": _period}, daily, f"WITH bars AS ({DAILY}) SELECT {PLAIN} FROM bars WHERE {_test}")

# Expressions: each is a mapped column x

EXPRESSIONS = {
    "arith": ("(high - low) * 2 + close / open - -volume", "(high - low) * 2 + close / open + volume"),
    "mod_floordiv": ("(close - 250000) // 1000 + (close - 250000) % 7", "floor((close - 250000) / 1000) + ((close - 250000) - floor((close - 250000) / 7) * 7)"),
    "compare": ("if(close > prev(close), 1, 0)", "CASE WHEN close > lag(close) OVER (ORDER BY ts) THEN 1 ELSE 0 END"),
    "not_missing": ("if(not (close > prev(close)), 1, 0)", "CASE WHEN close > lag(close) OVER (ORDER BY ts) THEN 0 ELSE 1 END"),
    "chain": ("if(100000 < close <= 200000, 1, 0)", "CASE WHEN close > 100000 AND close <= 200000 THEN 1 ELSE 0 END"),
    "in": ("if(dayofweek() in [0, 4], 1, 0)", "CASE WHEN (dayofweek(ts) + 6) % 7 IN (0, 4) THEN 1 ELSE 0 END"),
    "not_in": ("if(month() not in [1, 12], 1, 0)", "CASE WHEN month(ts) NOT IN (1, 12) THEN 1 ELSE 0 END"),
    "bool": ("if(close > open and (volume > 1 or high > 300000), 1, 0)", "CASE WHEN close > open AND (volume > 1 OR high > 300000) THEN 1 ELSE 0 END"),
    "date": ("if(date() >= '2000-01-01', 1, 0)", "CASE WHEN CAST(ts AS DATE) >= DATE '2000-01-01' THEN 1 ELSE 0 END"),
}
for _name, (_text, _sql) in EXPRESSIONS.items():
    _whole = _text.startswith("if(")
    ask(f"expr_{_name}", {"map": {"x": _text}, "columns": ["ts", "x"]}, daily, f"WITH bars AS ({DAILY}) SELECT {TS}, {f'CAST({_sql} AS BIGINT)' if _whole else rnd(_sql)} AS x FROM bars")

# Functions: each is a mapped column x over daily bars, or over hourly ones

BY = "OVER (ORDER BY ts)"
SO_FAR = "OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def last(n: int) -> str:
    return f"OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {last(n)} = {n} THEN {agg}({x}) {last(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {BY}"


def wma_sql(x: str, n: int) -> str:
    terms = [f"{lag(x, n - k)} * {k}" if k < n else f"{x} * {n}" for k in range(1, n + 1)]
    return "(" + " + ".join(terms) + f") / {n * (n + 1) / 2}"


TP = "(high + low + close) / 3"
TRUE_RANGE = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
ROWS: dict[str, tuple[str, str, str]] = {
    # name: (expression, SQL value, kind)
    "abs": ("abs(close - 250000)", "abs(close - 250000)", "num"),
    "log": ("log(close)", "ln(close)", "num"),
    "sqrt": ("sqrt(close)", "sqrt(close)", "num"),
    "sign": ("sign(close - 250000)", "CAST(sign(close - 250000) AS DOUBLE)", "num"),
    "round": ("round(volume / 4)", "round_even(volume / 4, 0)", "num"),
    "if": ("if(close > open, high, low)", "CASE WHEN close > open THEN high ELSE low END", "num"),
    "prev": ("prev(close, 2)", lag("close", 2), "num"),
    "next": ("next(close)", f"lead(close, 1) {BY}", "num"),
    "rolling_mean": ("rolling_mean(close, 20)", full("avg", "close", 20), "num"),
    "sma": ("sma(close, 5)", full("avg", "close", 5), "num"),
    "rolling_sum": ("rolling_sum(close, 20)", full("sum", "close", 20), "num"),
    "rolling_max": ("rolling_max(high, 20)", full("max", "high", 20), "num"),
    "rolling_min": ("rolling_min(low, 20)", full("min", "low", 20), "num"),
    "rolling_std": ("rolling_std(close, 20)", full("stddev_samp", "close", 20), "num"),
    "rolling_count": ("rolling_count(close > open, 10)", full("sum", "CAST(close > open AS INT)", 10), "num"),
    "wma": ("wma(close, 5)", wma_sql("close", 5), "num"),
    "vwma": ("vwma(20) / 7.1234567", f"CASE WHEN count(close) {last(20)} = 20 THEN sum(close * volume) {last(20)} / sum(volume) {last(20)} / 7.1234567 END", "num"),
    "cummax": ("cummax(close)", f"max(close) {SO_FAR}", "num"),
    "cummin": ("cummin(close)", f"min(close) {SO_FAR}", "num"),
    "cumsum": ("cumsum(volume)", f"sum(volume) {SO_FAR}", "num"),
    "bars_since": ("bars_since(close > 400000)", f"CAST(row_number() {BY} - max(CASE WHEN close > 400000 THEN rn END) {SO_FAR} AS DOUBLE)", "num"),
    "rank": ("rank(volume)", "(rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2.0) / count(*) OVER ()", "num"),
    "rising": ("rising(close, 2)", f"coalesce(close > {lag('close')} AND close > {lag('close', 2)}, false)", "bool"),
    "falling": ("falling(close, 2)", f"coalesce(close < {lag('close')} AND close < {lag('close', 2)}, false)", "bool"),
    "year": ("year()", "year(ts)", "int"),
    "quarter": ("quarter()", "quarter(ts)", "int"),
    "month": ("month()", "month(ts)", "int"),
    "day_of_month": ("day_of_month()", "day(ts)", "int"),
    "dayofweek": ("dayofweek()", "(dayofweek(ts) + 6) % 7", "int"),
    "date": ("date()", "CAST(ts AS DATE)", "date"),
    "gap": ("gap()", f"open - {lag('close')}", "num"),
    "gap_pct": ("gap_pct()", f"(open - {lag('close')}) / {lag('close')} * 100", "num"),
    "change": ("change(close, 3)", f"close - {lag('close', 3)}", "num"),
    "change_pct": ("change_pct(close, 3)", f"(close - {lag('close', 3)}) / {lag('close', 3)} * 100", "num"),
    "roc": ("roc(close, 5)", f"(close - {lag('close', 5)}) / {lag('close', 5)} * 100", "num"),
    "momentum": ("momentum(close)", f"close - {lag('close', 10)}", "num"),
    "range": ("range()", "high - low", "num"),
    "range_pct": ("range_pct()", "(high - low) / low * 100", "num"),
    "midpoint": ("midpoint()", "(high + low) / 2", "num"),
    "typical_price": ("typical_price()", TP, "num"),
    "body": ("body()", "close - open", "num"),
    "body_pct": ("body_pct()", "(close - open) / open * 100", "num"),
    "upper_wick": ("upper_wick()", "high - greatest(open, close)", "num"),
    "lower_wick": ("lower_wick()", "least(open, close) - low", "num"),
    "green": ("green()", "close > open", "bool"),
    "red": ("red()", "close < open", "bool"),
    "doji": ("doji(0.2)", "CASE WHEN high = low THEN false ELSE abs(close - open) / (high - low) < 0.2 END", "bool"),
    "inside_bar": ("inside_bar()", f"coalesce(high < {lag('high')} AND low > {lag('low')}, false)", "bool"),
    "outside_bar": ("outside_bar()", f"coalesce(high > {lag('high')} AND low < {lag('low')}, false)", "bool"),
    "crossover": ("crossover(close, open)", f"coalesce({lag('close')} <= {lag('open')} AND close > open, false)", "bool"),
    "crossunder": ("crossunder(close, open)", f"coalesce({lag('close')} >= {lag('open')} AND close < open, false)", "bool"),
    "stoch_k": ("stoch_k()", f"CASE WHEN count(high) {last(14)} = 14 THEN (close - min(low) {last(14)}) / (max(high) {last(14)} - min(low) {last(14)}) * 100 END", "num"),
    "williams_r": ("williams_r()", f"CASE WHEN count(high) {last(14)} = 14 THEN (max(high) {last(14)} - close) / (max(high) {last(14)} - min(low) {last(14)}) * -100 END", "num"),
    "tr": ("tr()", TRUE_RANGE, "num"),
    "bbands_upper": ("bbands_upper(close)", f"CASE WHEN count(close) {last(20)} = 20 THEN avg(close) {last(20)} + 2 * stddev_pop(close) {last(20)} END", "num"),
    "bbands_middle": ("bbands_middle(close)", full("avg", "close", 20), "num"),
    "bbands_lower": ("bbands_lower(close)", f"CASE WHEN count(close) {last(20)} = 20 THEN avg(close) {last(20)} - 2 * stddev_pop(close) {last(20)} END", "num"),
    "bbands_width": ("bbands_width(close)", f"CASE WHEN count(close) {last(20)} = 20 THEN 4 * stddev_pop(close) {last(20)} / avg(close) {last(20)} * 100 END", "num"),
    "bbands_pctb": ("bbands_pctb(close)", f"CASE WHEN count(close) {last(20)} = 20 THEN (close - avg(close) {last(20)} + 2 * stddev_pop(close) {last(20)}) / (4 * stddev_pop(close) {last(20)}) END", "num"),
    "donchian_upper": ("donchian_upper()", full("max", "high", 20), "num"),
    "donchian_lower": ("donchian_lower()", full("min", "low", 20), "num"),
    "volume_ratio": ("volume_ratio()", f"CASE WHEN count(volume) {last(20)} = 20 THEN volume / avg(volume) {last(20)} END", "num"),
    "volume_sma": ("volume_sma()", full("avg", "volume", 20), "num"),
    "pivothigh": (
        "pivothigh(3, 2)",
        f"CASE WHEN count(high) {last(6)} = 6 AND {lag('high', 2)} > max(high) OVER (ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AND {lag('high', 2)} > max(high) OVER (ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) THEN {lag('high', 2)} END",
        "num",
    ),
    "pivotlow": (
        "pivotlow(3, 2)",
        f"CASE WHEN count(low) {last(6)} = 6 AND {lag('low', 2)} < min(low) OVER (ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AND {lag('low', 2)} < min(low) OVER (ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) THEN {lag('low', 2)} END",
        "num",
    ),
    # Aggregates of all bars, on every row
    "mean": ("mean(close)", "avg(close) OVER ()", "num"),
    "sum": ("sum(volume)", "sum(volume) OVER ()", "num"),
    "max": ("max(high)", "max(high) OVER ()", "num"),
    "min": ("min(low)", "min(low) OVER ()", "num"),
    "std": ("std(close)", "stddev_samp(close) OVER ()", "num"),
    "median": ("median(close)", "median(close) OVER ()", "num"),
    "count": ("count()", "count(*) OVER ()", "int"),
    "pct": ("pct(close > open)", "avg(CAST(close > open AS INT)) OVER ()", "num"),
    "percentile": ("percentile(close, 0.9)", "quantile_cont(close, 0.9) OVER ()", "num"),
    "correlation": ("correlation(close, volume)", "corr(close, volume) OVER ()", "num"),
    "last": ("last(close)", "last_value(close) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "num"),
}

#: Several steps of SQL: the last step is called out and has ts, rn and x.
NUMBERED = f"b0 AS ({DAILY}), bars AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM b0)"


def ema_sql(name: str, source: str, n: int) -> str:
    a = 2.0 / (n + 1)
    return f"{name} AS (SELECT rn, x FROM {source} WHERE rn = 1 UNION ALL SELECT s.rn, {1 - a!r} * r.x + {a!r} * s.x FROM {name} r JOIN {source} s ON s.rn = r.rn + 1)"


def rma_sql(name: str, source: str, n: int, skip: int = 0) -> str:
    return (
        f"{name} AS (SELECT CAST({n + skip} AS BIGINT) AS rn, (SELECT avg(x) FROM {source} WHERE rn > {skip} AND rn <= {n + skip}) AS x "
        f"UNION ALL SELECT s.rn, s.x / {n}.0 + {1 - 1 / n!r} * r.x FROM {name} r JOIN {source} s ON s.rn = r.rn + 1)"
    )


def of(name: str, value: str) -> str:
    return f"{name} AS (SELECT rn, {value} AS x FROM bars)"


def joined(value: str, *names: str) -> str:
    return f"out AS (SELECT bars.ts, bars.rn, {value} AS x FROM bars " + " ".join(f"LEFT JOIN {n} ON {n}.rn = bars.rn" for n in names) + ")"


_C = of("c", "close")
_TR = of("tr", TRUE_RANGE)
_DM = [
    of("pdm", f"CASE WHEN high - {lag('high')} > {lag('low')} - low AND high - {lag('high')} > 0 THEN high - {lag('high')} ELSE 0.0 END"),
    of("mdm", f"CASE WHEN {lag('low')} - low > high - {lag('high')} AND {lag('low')} - low > 0 THEN {lag('low')} - low ELSE 0.0 END"),
    _TR,
    rma_sql("rp", "pdm", 14),
    rma_sql("rm", "mdm", 14),
    rma_sql("rt", "tr", 14),
]
_MACD = [_C, ema_sql("e1", "c", 12), ema_sql("e2", "c", 26), "m AS (SELECT e1.rn, e1.x - e2.x AS x FROM e1 JOIN e2 USING (rn))"]
_KC = [_C, _TR, ema_sql("e1", "c", 20), rma_sql("r", "tr", 10)]
_STEP = f"coalesce(close - {lag('close')}, 0.0)"
_FLOW = f"{TP} - lag({TP}) {BY}"
_SUPER = [
    _TR,
    rma_sql("r", "tr", 10),
    "s AS (SELECT bars.rn, high, low, close, r.x AS atr FROM bars LEFT JOIN r ON r.rn = bars.rn)",
    "st AS (SELECT rn, close, atr, (high + low) / 2 + 3 * atr AS up, (high + low) / 2 - 3 * atr AS lo, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS dir FROM s WHERE rn = 9 "
    "UNION ALL SELECT rn, close, atr, u, l, CASE WHEN rising THEN l ELSE u END, CASE WHEN rising THEN 1.0 ELSE -1.0 END FROM ("
    "SELECT *, CASE WHEN patr IS NULL OR px IS NULL THEN false WHEN px = pup THEN close > u ELSE NOT close < l END AS rising FROM ("
    "SELECT s.rn, s.close, s.atr, p.atr AS patr, p.x AS px, p.up AS pup, "
    "CASE WHEN p.up IS NULL OR (s.high + s.low) / 2 + 3 * s.atr < p.up OR p.close > p.up THEN (s.high + s.low) / 2 + 3 * s.atr ELSE p.up END AS u, "
    "CASE WHEN p.lo IS NULL OR (s.high + s.low) / 2 - 3 * s.atr > p.lo OR p.close < p.lo THEN (s.high + s.low) / 2 - 3 * s.atr ELSE p.lo END AS l "
    "FROM st p JOIN s ON s.rn = p.rn + 1)))",
]
_SAR = [
    "n AS (SELECT rn, high, low, close, lead(close) OVER (ORDER BY rn) AS c1, lag(high) OVER (ORDER BY rn) AS h1, lag(low) OVER (ORDER BY rn) AS l1, lag(high, 2) OVER (ORDER BY rn) AS h2, lag(low, 2) OVER (ORDER BY rn) AS l2 FROM bars)",
    "st AS (SELECT rn, c1 >= close AS up, CASE WHEN c1 >= close THEN low ELSE high END AS x, CASE WHEN c1 >= close THEN high ELSE low END AS ep, 0.02 AS af FROM n WHERE rn = 1 "
    "UNION ALL SELECT rn, CASE WHEN up THEN NOT low < s ELSE high > s END, CASE WHEN (up AND low < s) OR (NOT up AND high > s) THEN ep ELSE s END, "
    "CASE WHEN up AND low < s THEN low WHEN NOT up AND high > s THEN high WHEN up THEN greatest(ep, high) ELSE least(ep, low) END, "
    "CASE WHEN (up AND low < s) OR (NOT up AND high > s) THEN 0.02 WHEN (up AND high > ep) OR (NOT up AND low < ep) THEN least(af + 0.02, 0.2) ELSE af END FROM ("
    "SELECT n.*, p.up, p.ep, p.af, CASE WHEN p.up THEN least(p.x + p.af * (p.ep - p.x), l1, coalesce(l2, l1)) ELSE greatest(p.x + p.af * (p.ep - p.x), h1, coalesce(h2, h1)) END AS s "
    "FROM st p JOIN n ON n.rn = p.rn + 1))",
]
STEPS: dict[str, tuple[str, list[str], str]] = {
    "ema": ("ema(close, 12)", [_C, ema_sql("e", "c", 12), joined("e.x", "e")], "num"),
    "rma": ("rma(close, 14)", [_C, rma_sql("e", "c", 14), joined("e.x", "e")], "num"),
    "hma": (
        "hma(close, 9)",
        [f"w AS (SELECT ts, rn, 2 * ({wma_sql('close', 4)}) - ({wma_sql('close', 9)}) AS v FROM bars)", f"out AS (SELECT ts, rn, {wma_sql('v', 3)} AS x FROM w)"],
        "num",
    ),
    "streak": (
        "streak(close > open)",
        [f"g AS (SELECT ts, rn, CAST(close > open AS INT) AS y, sum(1 - CAST(close > open AS INT)) {SO_FAR} AS g FROM bars)", "out AS (SELECT ts, rn, sum(y) OVER (PARTITION BY g ORDER BY ts ROWS UNBOUNDED PRECEDING) AS x FROM g)"],
        "int",
    ),
    "valuewhen": (
        "valuewhen(close > open, high, 1)",
        [
            f"k AS (SELECT ts, rn, high, close > open AS y, sum(CAST(close > open AS INT)) {SO_FAR} AS k FROM bars)",
            "out AS (SELECT a.ts, a.rn, b.high AS x FROM k a LEFT JOIN k b ON b.y AND b.k = a.k - 1)",
        ],
        "num",
    ),
    "obv": ("obv()", [f"s AS (SELECT ts, rn, coalesce(volume * sign(close - {lag('close')}), 0) AS v FROM bars)", f"out AS (SELECT ts, rn, sum(v) {SO_FAR} AS x FROM s)"], "num"),
    "ad_line": (
        "ad_line()",
        ["s AS (SELECT ts, rn, CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) END * volume AS v FROM bars)", f"out AS (SELECT ts, rn, sum(v) {SO_FAR} AS x FROM s)"],
        "num",
    ),
    "stoch_d": ("stoch_d()", [f"k AS (SELECT ts, rn, {ROWS['stoch_k'][1]} AS v FROM bars)", f"out AS (SELECT ts, rn, {full('avg', 'v', 3)} AS x FROM k)"], "num"),
    "cci": (
        "cci(10)",
        [
            f"t AS (SELECT ts, rn, {TP} AS v FROM bars)",
            f"m AS (SELECT ts, rn, v, {full('avg', 'v', 10)} AS m FROM t)",
            "out AS (SELECT ts, rn, (v - m) / (0.015 * (" + " + ".join(["abs(v - m)"] + [f"abs({lag('v', i)} - m)" for i in range(1, 10)]) + ") / 10) AS x FROM m)",
        ],
        "num",
    ),
    "mfi": (
        "mfi()",
        [
            f"f AS (SELECT ts, rn, CASE WHEN {_FLOW} > 0 THEN {TP} * volume ELSE 0.0 END AS u, CASE WHEN {_FLOW} < 0 THEN {TP} * volume ELSE 0.0 END AS d FROM bars)",
            f"out AS (SELECT ts, rn, CASE WHEN count(u) {last(14)} = 14 THEN 100 - 100 / (1 + sum(u) {last(14)} / sum(d) {last(14)}) END AS x FROM f)",
        ],
        "num",
    ),
    "rsi": (
        "rsi(close)",
        [of("u", f"greatest({_STEP}, 0.0)"), of("d", f"greatest(-({_STEP}), 0.0)"), rma_sql("ru", "u", 14), rma_sql("rd", "d", 14), joined("100 - 100 / (1 + ru.x / rd.x)", "ru", "rd")],
        "num",
    ),
    "atr": ("atr()", [_TR, rma_sql("r", "tr", 14), joined("r.x", "r")], "num"),
    "natr": ("natr()", [_TR, rma_sql("r", "tr", 14), joined("r.x / close * 100", "r")], "num"),
    "kc_upper": ("kc_upper()", [*_KC, joined("e1.x + 1.5 * r.x", "e1", "r")], "num"),
    "kc_middle": ("kc_middle()", [*_KC, joined("e1.x", "e1")], "num"),
    "kc_lower": ("kc_lower()", [*_KC, joined("e1.x - 1.5 * r.x", "e1", "r")], "num"),
    "kc_width": ("kc_width()", [*_KC, joined("3 * r.x / e1.x", "e1", "r")], "num"),
    "macd": ("macd(close)", [*_MACD, joined("m.x", "m")], "num"),
    "macd_signal": ("macd_signal(close)", [*_MACD, ema_sql("s", "m", 9), joined("s.x", "s")], "num"),
    "macd_hist": ("macd_hist(close)", [*_MACD, ema_sql("s", "m", 9), joined("m.x - s.x", "m", "s")], "num"),
    "plus_di": ("plus_di()", [*_DM, joined("rp.x / rt.x * 100", "rp", "rt")], "num"),
    "minus_di": ("minus_di()", [*_DM, joined("rm.x / rt.x * 100", "rm", "rt")], "num"),
    "adx": (
        "adx()",
        [*_DM, "dx AS (SELECT rp.rn, abs(rp.x - rm.x) / (rp.x + rm.x) * 100 AS x FROM rp JOIN rm USING (rn))", rma_sql("a", "dx", 14, 13), joined("a.x", "a")],
        "num",
    ),
    "supertrend": ("supertrend()", [*_SUPER, joined("st.x", "st")], "num"),
    "supertrend_dir": ("supertrend_dir()", [*_SUPER, joined("st.dir", "st")], "num"),
    "sar": ("sar()", [*_SAR, joined("st.x", "st")], "num"),
}


def _typed(x: str, kind: str) -> str:
    return {"num": rnd(x), "int": f"CAST({x} AS BIGINT)", "bool": x, "date": x}[kind]


for _name, (_text, _sql, _kind) in ROWS.items():
    ask(f"fn_{_name}", {"map": {"x": _text}, "columns": ["ts", "x"]}, daily, f"WITH {NUMBERED} SELECT {TS}, {_typed(_sql, _kind)} AS x FROM bars")
for _name, (_text, _parts, _kind) in STEPS.items():
    ask(f"fn_{_name}", {"map": {"x": _text}, "columns": ["ts", "x"]}, daily, f"WITH RECURSIVE {NUMBERED}, {', '.join(_parts)} SELECT {TS}, {_typed('x', _kind)} AS x FROM out")

TYPED = f"WITH bars AS ({intraday_sql(60)})"
DAY = "PARTITION BY CAST(ts AS DATE)"
for _name, _text, _sql, _kind in (
    ("hour", "hour()", "hour(ts)", "int"),
    ("minute", "minute()", "minute(ts)", "int"),
    ("vwap_day", "vwap_day()", f"sum({TP} * volume) OVER ({DAY} ORDER BY ts ROWS UNBOUNDED PRECEDING) / sum(volume) OVER ({DAY} ORDER BY ts ROWS UNBOUNDED PRECEDING)", "num"),
):
    ask(f"fn_{_name}", {"map": {"x": _text}, "columns": ["ts", "x"]}, hourly, f"{TYPED} SELECT {TS}, {_typed(_sql, _kind)} AS x FROM bars")
TAG = "CAST(ts AS DATE) + CASE WHEN hour(ts) >= 18 THEN 1 ELSE 0 END"
for _name, _sql in (
    ("session_high", "max(high) OVER (PARTITION BY sid)"),
    ("session_low", "min(low) OVER (PARTITION BY sid)"),
    ("session_open", "first_value(open) OVER (PARTITION BY sid ORDER BY ts)"),
    ("session_close", "last_value(close) OVER (PARTITION BY sid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
):
    ask(
        f"fn_{_name}",
        {"session": "ETH", "map": {"x": f"{_name}()"}, "columns": ["ts", "x"]},
        hourly,
        f"WITH b0 AS ({intraday_sql(60)}), bars AS (SELECT *, {TAG} AS sid FROM b0 WHERE hour(ts) >= 18 OR hour(ts) < 17) SELECT {TS}, {rnd(_sql)} AS x FROM bars",
        sessions=SESSIONS,
    )

# Aggregation contexts

B = f"WITH bars AS ({DAILY})"
ask("agg_grouped", {"map": {"y": "year()"}, "group_by": "y", "select": "count(), mean(close), sum(volume), max(high), min(low), std(close), median(close)"}, daily,
    f"{B} SELECT CAST(year(ts) AS BIGINT) AS y, count(*) AS count, {rnd('avg(close)')} AS mean_close, {rnd('sum(volume)')} AS sum_volume, {rnd('max(high)')} AS max_high, {rnd('min(low)')} AS min_low, {rnd('stddev_samp(close)')} AS std_close, {rnd('median(close)')} AS median_close FROM bars GROUP BY 1")
ask("agg_multi_key", {"map": {"y": "year()", "up": "close > open"}, "group_by": ["y", "up"], "select": "count(), pct(up)"}, daily,
    f"{B} SELECT CAST(year(ts) AS BIGINT) AS y, close > open AS up, count(*) AS count, {rnd('avg(CAST(close > open AS INT))')} AS pct_up FROM bars GROUP BY 1, 2")
ask("agg_scalar", {"where": "close > open", "select": "mean(close)"}, daily, f"{B} SELECT {rnd('avg(close)')} AS mean_close FROM bars WHERE close > open")
ask("agg_dict", {"select": ["count()", "max(high)", "min(low)", "max(high) - min(low)"]}, daily, f"{B} SELECT count(*) AS count, {rnd('max(high)')} AS max_high, {rnd('min(low)')} AS min_low, {rnd('max(high) - min(low)')} AS \"max(high) - min(low)\" FROM bars")
ask("agg_pct", {"map": {"g": "gap_pct()"}, "select": "pct(g > 0)"}, daily, f"{B}, g AS (SELECT open > {lag('close')} AS g FROM bars) SELECT {rnd('sum(CASE WHEN g THEN 1 ELSE 0 END) / count(*)')} AS \"pct(g > 0)\" FROM g")
ask("agg_percentile", {"select": ["percentile(close, 0.95)"]}, daily, f"{B} SELECT {rnd('quantile_cont(close, 0.95)')} AS \"percentile_close\" FROM bars")
ask("agg_correlation", {"select": ["correlation(close, open)"]}, daily, f"{B} SELECT {rnd('corr(close, open)')} AS correlation_close FROM bars")
ask("agg_last", {"select": "last(close)"}, daily, f"{B} SELECT {rnd('arg_max(close, ts)')} AS last_close FROM bars")
ask("agg_broadcast", {"map": {"above": "close > mean(close)"}, "where": "above", "select": "count()"}, daily, f"{B} SELECT count(*) AS count FROM bars WHERE close > (SELECT avg(close) FROM bars)")
ask("where_window", {"map": {"m": "sma(close, 20)"}, "where": "close > m and prev(close) <= m", "columns": ["ts", "m"]}, daily,
    f"{B}, w AS (SELECT ts, close, {full('avg', 'close', 20)} AS m, {lag('close')} AS p FROM bars) SELECT {TS}, {rnd('m')} AS m FROM w WHERE close > m AND p <= m")

# Steps, order, projection, lineage

ask("steps_two", {"steps": [{"map": {"y": "year()", "m": "month()"}, "group_by": ["y", "m"], "select": "sum(volume)"}, {"group_by": "y", "select": "mean(sum_volume)"}]}, daily,
    f"{B}, s AS (SELECT year(ts) AS y, month(ts) AS m, sum(volume) AS v FROM bars GROUP BY 1, 2) SELECT CAST(y AS BIGINT) AS y, {rnd('avg(v)')} AS mean_sum_volume FROM s GROUP BY 1")
ask("steps_three", {"steps": [{"from": "weekly", "map": {"r": "range()"}}, {"map": {"big": "r > mean(r)"}, "where": "big"}, {"map": {"y": "year()"}, "group_by": "y", "select": "count(), mean(r)"}]}, daily,
    f"{B}, w AS (SELECT date_trunc('week', ts) + INTERVAL 6 DAY AS ts, max(high) - min(low) AS r FROM bars GROUP BY 1) SELECT CAST(year(ts) AS BIGINT) AS y, count(*) AS count, {rnd('avg(r)')} AS mean_r FROM w WHERE r > (SELECT avg(r) FROM w) GROUP BY 1")
ask("steps_nested", {"steps": [{"map": {"y": "year()", "q": "quarter()"}, "group_by": ["y", "q"], "select": "mean(close)"}, {"group_by": "y", "select": "max(mean_close)"}, {"select": "mean(max_mean_close)"}]}, daily,
    f"{B}, s AS (SELECT year(ts) AS y, quarter(ts) AS q, avg(close) AS v FROM bars GROUP BY 1, 2), t AS (SELECT y, max(v) AS v FROM s GROUP BY 1) SELECT {rnd('avg(v)')} AS mean_max_mean_close FROM t")
ask("sort_limit", {"map": {"r": "range()"}, "sort": "r desc", "limit": 10, "columns": ["ts", "r"]}, daily, f"{B} SELECT {TS}, {rnd('high - low')} AS r FROM bars ORDER BY high - low DESC, bars.ts LIMIT 10")
ask("columns", {"map": {"r": "range()"}, "columns": ["date", "close", "r", "nothing"]}, daily, f"{B} SELECT strftime(ts, '%Y-%m-%d') AS date, {rnd('close')} AS close, {rnd('high - low')} AS r FROM bars")
ask("multi_symbol", {"map": {"m": "sma(close, 10)", "d": "close > m"}, "group_by": "symbol", "select": "count(), pct(d), mean(m)"}, lambda s, d: src.order_bars(s, d, True),
    f"WITH bars AS ({DAILY_MULTI}), w AS (SELECT symbol, close, CASE WHEN count(close) OVER w = 10 THEN avg(close) OVER w END AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) "
    f"SELECT symbol, count(*) AS count, {rnd('avg(CASE WHEN close > m THEN 1 ELSE 0 END)')} AS pct_d, {rnd('avg(m)')} AS mean_m FROM w GROUP BY 1")  # fmt: skip
add("source_rows", lambda s, d: shown(plan({"map": {"r": "range()"}, "where": "r > 300000", "select": "mean(r)"}, daily(s, d)).source.select("ts", "r")), f"{B} SELECT {TS}, {rnd('high - low')} AS r FROM bars WHERE high - low > 300000")
add("summary_stats", lambda s, d: shown(response.statistics(plan({"map": {"r": "range()"}}, daily(s, d))), 2), f"{B} SELECT count(*) AS rows, {rnd('min(high - low)', 2)} AS r_min, {rnd('max(high - low)', 2)} AS r_max, {rnd('avg(round(high - low, 4))', 2)} AS r_mean FROM bars")
add("formatted_labels", lambda s, d: response.formatted(plan({"map": {"dow": "dayofweek()", "m": "month()"}, "group_by": ["dow", "m"]}, daily(s, d))), f"{B} SELECT dayname(ts) AS dow, monthname(ts) AS m, count(*) AS count FROM bars GROUP BY 1, 2")

# Sessions, profiles and comparisons

add("session_gap", lambda s, d: tf.gap_sessions(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("symbol"), "ts")).groupBy("symbol").agg(F.max("__session_id").alias("sessions")),
    "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 90 MINUTE THEN 1 ELSE 0 END AS n FROM events) SELECT symbol, CAST(sum(n) AS BIGINT) AS sessions FROM e GROUP BY 1")
add("session_profile", lambda s, d: shown(cal.session_profile(hourly(s, d)).drop("symbol")),
    f"{TYPED}, p AS (SELECT CAST({MINUTE} AS BIGINT) AS minute, count(*) AS bars, sum(volume) AS volume FROM bars GROUP BY 1) SELECT minute, bars, volume, minute - coalesce(lag(minute) OVER (ORDER BY minute), -1) - 1 AS empty_before FROM p")


def _compare(spark, d):
    """Daily closes of all orders against those of urgent ones only, which lack days."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    bars = lambda rows: src.bars_from(rows, F.lit("ALL"), F.col("o_orderdate"), F.col("o_totalprice"), [F.col("o_orderkey")])
    late = bars(orders.filter("o_orderpriority = '1-URGENT' and o_orderkey % 3 <> 0"))
    return shown(cal.compare_daily(bars(orders.filter("o_custkey % 2 = 0")), late).drop("symbol"))


add("compare_daily", _compare,
    "WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS c FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1), "
    "b AS (SELECT CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS c FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 <> 0 GROUP BY 1) "
    f"SELECT date, {rnd('a.c')} AS close_a, {rnd('b.c')} AS close_b, {rnd('a.c - b.c')} AS diff FROM a FULL JOIN b USING (date)")  # fmt: skip


def _asof_events(spark, d):
    """Each purchase with its user's last view before it, at most 30 days old."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", "value", "event_type")
    buys, views = (e.filter(F.col("event_type") == t).drop("event_type") for t in ("purchase", "view"))
    found = joins.asof(buys, views, ["user_id"], "ts", "ts", "view_", ties=["event_id"], tolerance=30 * 86_400_000_000)
    return shown(found.select("event_id", "user_id", "value", F.col("view_event_id"), "view_value"), 2)


add("asof_last_view", _asof_events,
    "WITH b AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view') "
    "SELECT b.event_id, b.user_id, round(b.value, 2) + 0.0 AS value, CASE WHEN b.ts - v.ts <= INTERVAL 30 DAY THEN v.event_id END AS view_event_id, CASE WHEN b.ts - v.ts <= INTERVAL 30 DAY THEN round(v.value, 2) + 0.0 END AS view_value "
    "FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts >= v.ts")  # fmt: skip
add("asof_bars", lambda s, d: shown(joins.asof(src.event_bars(s, d, 60, True), s.read.parquet(f"{d}/events.parquet").filter("event_type = 'error'").select("event_id", "ts", "value"), [], "ts", "ts", "error_", ties=["event_id"], strict=True, how="inner").select("symbol", "ts", "close", "error_event_id", "error_value")),
    f"WITH bars AS ({intraday_sql(60, True)}), e AS (SELECT event_id, ts, value FROM events WHERE event_type = 'error') SELECT symbol, strftime(bars.ts, '%Y-%m-%d %H:%M') AS ts, {rnd('close')} AS close, event_id AS error_event_id, {rnd('value')} AS error_value FROM bars ASOF JOIN e ON bars.ts > e.ts")


def _line_windows(spark, d):
    """Orders placed while a line of the same supplier nation's customers was on its way: orders within ten days before a shipment to their customer's nation."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    customers = F.broadcast(read("nation").select("n_nationkey", "n_name"))
    orders = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("date"), "o_orderkey")
    big = read("lineitem").filter("l_quantity >= 50 and l_discount >= 0.1").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    spans = big.select(F.col("c_nationkey").alias("nation"), F.date_sub(F.to_date("l_shipdate"), 10).alias("opens"), F.to_date("l_shipdate").alias("ships"))
    pairs = joins.within(orders, spans, ["nation"], "date", "opens", "ships")
    return shown(pairs.groupBy("nation").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("o_orderkey").alias("orders")).join(customers, F.col("nation") == F.col("n_nationkey")).select("n_name", "pairs", "orders"))


add("interval_shipments", _line_windows,
    "WITH o AS (SELECT c_nationkey AS n, CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey), "
    "s AS (SELECT c_nationkey AS n, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 50 AND l_discount >= 0.1) "
    "SELECT n_name, count(*) AS pairs, count(DISTINCT o_orderkey) AS orders FROM o JOIN s ON o.n = s.n AND o.d BETWEEN s.d - 10 AND s.d JOIN nation ON o.n = n_nationkey GROUP BY 1")  # fmt: skip

# Screens, correlations and sketches

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
KINDS = ("view", "click", "purchase", "signup", "error")


def pairs_sql(table: str, series: str, day: str, value: str, names) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return (
        f"WITH v AS (SELECT {series} AS s, {day} AS d, avg({value}) AS v FROM {table} WHERE {series} IN ({listed}) GROUP BY 1, 2) "
        "SELECT a.s AS a, b.s AS b, count(*) AS n, round(corr(a.v, b.v), 6) + 0.0 AS correlation FROM v a JOIN v b ON a.d = b.d AND a.s < b.s GROUP BY 1, 2 HAVING count(*) >= 2"
    )


add("correlation_matrix", lambda s, d: shown(rollups.correlations(s.read.parquet(f"{d}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", PRIORITIES), 6), pairs_sql("orders", "o_orderpriority", "o_orderdate", "o_totalprice", PRIORITIES))
add("correlation_events", lambda s, d: shown(rollups.correlations(s.read.parquet(f"{d}/events.parquet").withColumn("h", F.date_trunc("hour", "ts")), "event_type", "h", "value", KINDS), 6), pairs_sql("events", "event_type", "date_trunc('hour', ts)", "value", KINDS))
add("screener", lambda s, d: shown(rollups.screen(indicators(src.event_bars(s, d, 60, True), {"m": ("sma", "close", 20), "top": ("donchian_upper", 10), "before": ("prev", "close", 1)}), {"low": F.col("close") < F.col("m") * 2, "inside": F.col("high") <= F.col("top")})),
    f"WITH bars AS ({intraday_sql(60, True)}), w AS (SELECT symbol, ts, close < 2 * CASE WHEN count(close) OVER a = 20 THEN avg(close) OVER a END AS low, high <= CASE WHEN count(high) OVER b = 10 THEN max(high) OVER b END AS inside FROM bars "
    "WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) "
    "SELECT symbol, strftime(max(ts), '%Y-%m-%d %H:%M') AS ts, count(*) FILTER (low) AS low_bars, count(*) FILTER (inside) AS inside_bars, count(*) AS bars FROM w GROUP BY symbol HAVING arg_max(coalesce(low, false), ts) AND arg_max(coalesce(inside, false), ts)")  # fmt: skip


def _rolled(spark, d):
    """Minute sketches of events rolled up to months: counts and extremes are exact, quantiles and users are held against the exact ones."""
    e = spark.read.parquet(f"{d}/events.parquet")
    minutes = pin(rollups.sketches(e, ["event_type"], "ts", "value", "user_id"), "sketches")
    found = rollups.estimates(rollups.rolled_up(rollups.rolled_up(minutes, ["event_type"], "day"), ["event_type"], "month"), {"median": 0.5, "q90": 0.9})
    own = e.withColumn("bucket", F.date_trunc("month", "ts").cast("timestamp_ntz"))
    below = lambda name: F.sum((F.col("value") <= F.col(name)).cast("int")) / F.count("value")
    held = own.join(found, ["event_type", "bucket"]).groupBy("event_type", F.col("bucket").alias("ts")).agg(
        F.first("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("mean").alias("mean"),
        (F.abs(below("median") - 0.5) < 0.03).alias("median_near"), (F.abs(below("q90") - 0.9) < 0.03).alias("q90_near"), (F.abs(F.first("items") / F.countDistinct("user_id") - 1) < 0.05).alias("users_near"),
    )
    return shown(held, 3)


add("sketch_rollup", _rolled,
    f"SELECT event_type, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M') AS ts, count(value) AS n, {rnd('min(value)', 3)} AS low, {rnd('max(value)', 3)} AS high, {rnd('avg(value)', 3)} AS mean, true AS median_near, true AS q90_near, true AS users_near FROM events GROUP BY event_type, date_trunc('month', ts)")


def _through_text(spark, d):
    """Bars written as the two kinds of text files and read back: days by priority, minutes of all events."""
    days, minutes = src.order_bars(spark, d, True), src.event_bars(spark, d, 1)
    day_files, minute_files = shared_path(spark, "days"), shared_path(spark, "minutes")
    days.filter("symbol = '1-URGENT'").select(F.date_format("ts", "MM/dd/yyyy"), *src.PRICES, F.lit(0)).write.csv(day_files)
    minutes.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), *src.PRICES).write.csv(minute_files)
    return shown(src.read_daily_csv(spark, day_files, "urgent").unionByName(src.read_minute_csv(spark, minute_files, "events")))


add("read_csv", _through_text,
    f"WITH a AS ({DAILY_MULTI}), b AS ({intraday_sql(1)}), bars AS (SELECT 'URGENT' AS symbol, ts, open, high, low, close, volume FROM a WHERE symbol = '1-URGENT' UNION ALL SELECT 'EVENTS', ts, open, high, low, close, volume FROM b) SELECT symbol, {PLAIN} FROM bars")

# Simulator

STRATEGIES = {
    "stop": bt.Strategy("close > open", stop_loss="2%", exit_bars=10),
    "tp": bt.Strategy("close < prev(close)", take_profit="20%", stop_loss="30%", exit_bars=20),
    "trailing": bt.Strategy("rising(close, 2)", trailing_stop="10%", exit_bars=15),
    "breakeven": bt.Strategy("close > open", stop_loss="40%", breakeven_bars=2, exit_bars=12),
    "target": bt.Strategy("close < sma(close, 10)", exit_target="sma(close, 10)", stop_loss="50%", exit_bars=8),
    "short": bt.Strategy("falling(close, 2)", "short", stop_loss="15%", take_profit="15%", slippage=10, commission=5),
}


def trades(spark, d, name):
    return bt.simulate(src.order_bars(spark, d, True), STRATEGIES[name])


def shown_trades(df: DataFrame) -> DataFrame:
    return shown(df.select("symbol", "entry_date", "entry_price", "exit_date", "exit_price", "direction", "pnl", "exit_reason", "bars_held"))


for _name in STRATEGIES:
    add(f"bt_trades_{_name}", lambda s, d, n=_name: shown_trades(trades(s, d, n)))
TIMEOUT = bt.Strategy("dayofweek() in [0, 1, 2, 3, 4, 5, 6]", exit_bars=4)
_T = (
    f"WITH RECURSIVE b0 AS ({DAILY}), bars AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM b0), "
    "t AS (SELECT a.rn, CAST(a.ts AS DATE) AS entry_date, a.open AS entry_price, CAST(b.ts AS DATE) AS exit_date, b.close AS exit_price, b.close - a.open AS pnl, "
    "CASE WHEN b.rn - a.rn = 4 THEN 'timeout' ELSE 'end' END AS exit_reason, b.rn - a.rn AS bars_held FROM bars a JOIN bars b ON b.rn = least(a.rn + 4, a.n) WHERE a.rn % 5 = 2 AND a.rn < a.n)"
)
add("bt_trades_timeout", lambda s, d: shown_trades(bt.simulate(daily(s, d), TIMEOUT)).drop("symbol", "direction"),
    f"{_T} SELECT entry_date, {rnd('entry_price')} AS entry_price, exit_date, {rnd('exit_price')} AS exit_price, {rnd('pnl')} AS pnl, exit_reason, bars_held FROM t")
_P = f"{_T}, p AS (SELECT *, round(pnl, 4) AS p, sum(round(pnl, 4)) OVER (ORDER BY rn) AS e FROM t), q AS (SELECT *, greatest(0, max(e) OVER (ORDER BY rn)) AS peak FROM p)"
add("bt_equity", lambda s, d: shown(bt.equity(bt.simulate(daily(s, d), TIMEOUT)).select("entry_date", "equity", "drawdown"), 2), f"{_P} SELECT entry_date, {rnd('e', 2)} AS equity, {rnd('e - peak', 2)} AS drawdown FROM q")
add("bt_metrics", lambda s, d: shown(bt.metrics(bt.simulate(daily(s, d), TIMEOUT)).drop("symbol", "max_consecutive_wins", "max_consecutive_losses"), 2),
    f"{_P} SELECT count(*) AS total_trades, count(*) FILTER (p > 0) AS winning_trades, count(*) FILTER (p <= 0) AS losing_trades, {rnd('100.0 * count(*) FILTER (p > 0) / count(*)', 2)} AS win_rate, "
    f"{rnd('sum(p) FILTER (p > 0) / -sum(p) FILTER (p <= 0)', 2)} AS profit_factor, {rnd('avg(p) FILTER (p > 0)', 2)} AS avg_win, {rnd('avg(p) FILTER (p <= 0)', 2)} AS avg_loss, {rnd('max(peak - e)', 2)} AS max_drawdown, "
    f"{rnd('sum(p)', 2)} AS total_pnl, {rnd('avg(p)', 2)} AS expectancy, {rnd('avg(bars_held)', 2)} AS avg_bars_held, {rnd('sum(p) / max(peak - e)', 2)} AS recovery_factor, "
    f"{rnd('sum(p) FILTER (p > 0)', 2)} AS gross_profit, {rnd('sum(p) FILTER (p <= 0)', 2)} AS gross_loss FROM q")  # fmt: skip
_RUNS = f"{_P}, r AS (SELECT p > 0 AS w, rn, row_number() OVER (ORDER BY rn) - row_number() OVER (PARTITION BY p > 0 ORDER BY rn) AS g FROM q), c AS (SELECT w, g, count(*) AS n FROM r GROUP BY 1, 2)"
add("bt_runs", lambda s, d: shown(bt.metrics(bt.simulate(daily(s, d), TIMEOUT)).select("max_consecutive_wins", "max_consecutive_losses")), f"{_RUNS} SELECT max(n) FILTER (w) AS max_consecutive_wins, max(n) FILTER (NOT w) AS max_consecutive_losses FROM c")
_SUMS = f"count(*) AS trades, count(*) FILTER (p > 0) AS wins, {rnd('sum(p)', 2)} AS pnl"
add("bt_by_exit", lambda s, d: shown(bt.by_exit(bt.simulate(daily(s, d), TIMEOUT)), 2), f"{_P} SELECT exit_reason, {_SUMS} FROM q GROUP BY 1")
add("bt_by_year", lambda s, d: shown(bt.by_year(bt.simulate(daily(s, d), TIMEOUT)), 2), f"{_P} SELECT CAST(year(entry_date) AS BIGINT) AS year, {_SUMS} FROM q GROUP BY 1")
add("bt_top3", lambda s, d: shown(bt.top_share(bt.simulate(daily(s, d), TIMEOUT)), 2),
    f"{_P} SELECT {rnd('sum(p)', 2)} AS total_pnl, {rnd('(SELECT sum(p) FROM (SELECT p FROM q ORDER BY p DESC LIMIT 3))', 2)} AS top_pnl, {rnd('(SELECT sum(p) FROM (SELECT p FROM q ORDER BY p DESC LIMIT 3)) / abs(sum(p)) * 100', 2)} AS share FROM q")
add("bt_fine_bars", lambda s, d: shown_trades(bt.simulate(src.event_bars(s, d, 60, True), bt.Strategy("close > open", stop_loss="30%", take_profit="30%", exit_bars=6), "4h", src.ticks(s, d, True))))

# Calendar

_MONTHS = "m AS (SELECT CAST(range AS DATE) AS m FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 MONTH))"
_NTH = "m + CAST((12 - dayofweek(m)) % 7 AS INT)"  # first Friday


def order_days(spark, d):
    """Orders and their value by day."""
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("value"))


_DAYS = "days AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders, sum(o_totalprice) AS value FROM orders GROUP BY 1)"


def _event_days(name: str, event: str, day: str, months: str = "") -> None:
    """Orders on the days of one event."""
    add(name, lambda s, d: shown(order_days(s, d).join(F.broadcast(cal.event_dates(s, event, "1992-01-01", "2001-12-31")), "date"), 2),
        f"WITH {_MONTHS.replace('1995', '1992')}, {_DAYS}, e AS (SELECT {day} AS date FROM m{months}) SELECT date, orders, {rnd('value', 2)} AS value FROM days JOIN e USING (date)")


_event_days("cal_opex", "opex", f"{_NTH} + 14")
_event_days("cal_nfp", "nfp", _NTH)
_event_days("cal_vix", "vix_exp", f"{_NTH} + 12")
_event_days("cal_quad_witching", "quad_witching", f"{_NTH} + 14", " WHERE month(m) IN (3, 6, 9, 12)")


def _holidays_sql(first: int, last: int) -> str:
    """Common tables up to ``h`` (exchange, date, holiday, day_type, close_time): Easter in whole numbers, weekdays by counting on."""
    nth = lambda m, w, n: f"make_date(y, {m}, 1) + CAST((({w} - isodow(make_date(y, {m}, 1)) + 7) % 7) + {7 * (n - 1)} AS INT)"
    moved = lambda d: f"{d} - CAST(isodow({d}) = 6 AS INT) + CAST(isodow({d}) = 7 AS INT)"
    before = lambda d: f"{d} - CASE isodow({d}) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END"
    on = lambda m, d: f"make_date(y, {m}, {d})"
    rule = {
        "new_year": moved(on(1, 1)), "mlk_day": nth(1, 1, 3), "presidents_day": nth(2, 1, 3), "good_friday": "easter - 2",
        "memorial_day": "make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INT)", "juneteenth": moved(on(6, 19)), "independence_day": moved(on(7, 4)),
        "labor_day": nth(9, 1, 1), "thanksgiving": nth(11, 4, 4), "christmas": moved(on(12, 25)), "independence_day_eve": before(on(7, 3)),
        "black_friday": nth(11, 4, 4) + " + 1", "christmas_eve": before(on(12, 24)), "new_year_eve": before(on(12, 31)),
    }
    days = " UNION ALL ".join(f"SELECT y, '{name}' AS holiday, {sql} AS date FROM e" for name, sql in rule.items())
    shut = "new_year mlk_day presidents_day good_friday memorial_day juneteenth independence_day labor_day thanksgiving christmas"
    kept = ", ".join(f"('US', '{n}', 'closed', NULL)" for n in shut.split()) + (
        ", ('US', 'independence_day_eve', 'early_close', '13:15'), ('US', 'black_friday', 'early_close', '13:15'), ('US', 'christmas_eve', 'early_close', '13:15'), ('US', 'new_year_eve', 'early_close', '13:15')"
        ", ('EU', 'new_year', 'closed', NULL), ('EU', 'good_friday', 'closed', NULL), ('EU', 'christmas', 'closed', NULL), ('EU', 'christmas_eve', 'early_close', '12:30'), ('EU', 'new_year_eve', 'early_close', '12:30')"
    )
    who = "('US', 'CME'), ('US', 'CBOT'), ('US', 'NYMEX'), ('US', 'COMEX'), ('US', 'ICEUS'), ('EU', 'ICEEUR'), ('EU', 'EUREX')"
    return (
        f"y AS (SELECT range AS y, range % 19 AS a, range // 100 AS b, range % 100 AS c FROM range({first}, {last + 1})), "
        "g AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM y), "
        "k AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM g), "
        "x AS (SELECT *, h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS x FROM k), "
        f"e AS (SELECT y, make_date(y, x // 31, x % 31 + 1) AS easter FROM x), d AS ({days}), "
        f"kept(region, holiday, day_type, close_time) AS (VALUES {kept}), who(region, exchange) AS (VALUES {who}), "
        "h AS (SELECT exchange, date, holiday, day_type, CAST(close_time AS VARCHAR) AS close_time FROM d JOIN kept USING (holiday) JOIN who USING (region) WHERE year(date) = y)"
    )


add("cal_holidays", lambda s, d: shown(order_days(s, d).join(F.broadcast(cal.holidays(s, 1992, 2001)), "date").groupBy("exchange", "holiday", "day_type").agg(F.count(F.lit(1)).alias("days"), F.sum("orders").alias("orders"))),
    f"WITH {_holidays_sql(1992, 2001)}, {_DAYS} SELECT exchange, holiday, day_type, count(*) AS days, CAST(sum(orders) AS BIGINT) AS orders FROM days JOIN h USING (date) GROUP BY ALL")
_OBSERVED = "d - CAST(dayofweek(d) = 6 AS INT) + CAST(dayofweek(d) = 0 AS INT)"


def _around_holidays(spark, d):
    """Orders in the days from three before to two after a holiday, by how many days off."""
    kept = cal.holidays(spark, 1992, 2001).filter("exchange = 'CME' and holiday in ('juneteenth', 'independence_day', 'christmas')")
    spans = kept.select("holiday", F.col("date").alias("day"), F.date_sub("date", 3).alias("opens"), F.date_add("date", 2).alias("closes"))
    pairs = joins.within(order_days(spark, d), spans, [], "date", "opens", "closes")
    return shown(pairs.groupBy("holiday", F.datediff("date", "day").alias("off")).agg(F.count(F.lit(1)).alias("days"), F.sum("orders").alias("orders")))


add("cal_fixed_holidays", _around_holidays,
    f"WITH y AS (SELECT range AS y FROM range(1992, 2002)), r AS (SELECT make_date(y, 6, 19) AS d, 'juneteenth' AS holiday FROM y UNION ALL SELECT make_date(y, 7, 4), 'independence_day' FROM y UNION ALL SELECT make_date(y, 12, 25), 'christmas' FROM y), "
    f"h AS (SELECT {_OBSERVED} AS day, holiday FROM r), {_DAYS} SELECT holiday, CAST(date - day AS BIGINT) AS off, count(*) AS days, CAST(sum(orders) AS BIGINT) AS orders FROM days JOIN h ON date BETWEEN day - 3 AND day + 2 GROUP BY ALL")  # fmt: skip
add("cal_day_type", lambda s, d: cal.annotate_holidays(daily(s, d).select(F.to_date("ts").alias("date")), s, "CME"),
    f"WITH {_holidays_sql(1990, 2060)}, one AS (SELECT date, arg_min(holiday, day_type) AS holiday, min(day_type) AS day_type, min(close_time) AS close_time FROM h WHERE exchange = 'CME' GROUP BY date), "
    "b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) "
    f"SELECT b.date, holiday, coalesce(day_type, 'regular') AS day_type, CASE WHEN day_type = 'closed' THEN NULL ELSE coalesce(close_time, '17:00') END AS close_time, "
    "isodow(b.date) < 6 AND coalesce(day_type, 'regular') <> 'closed' AS is_trading_day FROM b LEFT JOIN one ON b.date = one.date")  # fmt: skip


#: (exchange, first symbol, electronic session, regular session), in Eastern Time.
_HOURS = """('CME', 'ES', '18:00', '17:00', '09:30', '16:15'), ('CBOT', 'YM', '18:00', '17:00', '09:30', '16:15'), ('NYMEX', 'CL', '18:00', '17:00', '09:00', '14:30'),
    ('COMEX', 'GC', '18:00', '17:00', '08:20', '13:30'), ('CME', '6E', '18:00', '17:00', '08:20', '16:00'), ('CBOT', 'ZN', '18:00', '17:00', '08:20', '15:00'), ('CBOT', 'ZC', '20:00', '14:20', '09:30', '14:20'),
    ('EUREX', 'FDAX', '19:15', '16:00', '03:00', '11:30'), ('ICEEUR', 'BRN', '20:00', '17:00', '03:00', '14:30'), ('ICEUS', 'KC', '04:15', '13:25', '04:15', '13:25')"""


def _sessions(spark, d):
    """Events inside each instrument's sessions: a session is an interval on every day of the table, over midnight where it closes before it opens."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("ts", "value")
    known = ins.sessions(spark).filter("symbol in ('ES', 'YM', 'CL', 'GC', '6E', 'ZN', 'ZC', 'FDAX', 'BRN', 'KC')")
    days = rows.select(F.explode(F.array(F.to_date("ts"), F.date_sub(F.to_date("ts"), 1))).alias("day")).distinct()
    at = lambda day, clock: F.to_timestamp_ntz(F.concat_ws(" ", day, F.col(clock)), F.lit("yyyy-MM-dd HH:mm"))
    spans = days.join(F.broadcast(known)).select("exchange", "symbol", "session", at(F.col("day"), "opens").alias("begin"), at(F.date_add("day", F.when(F.col("closes") <= F.col("opens"), 1).otherwise(0)), "closes").alias("finish"))  # 10 instruments
    pairs = joins.within(rows, spans, [], "ts", "begin", "finish", closed=False)
    return shown(pairs.groupBy("exchange", "symbol", "session").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")), 2)


add("session_table", _sessions,
    f"WITH w(exchange, symbol, eo, ec, ro, rc) AS (VALUES {_HOURS}), s AS (SELECT exchange, symbol, 'ETH' AS session, eo AS opens, ec AS closes FROM w UNION ALL SELECT exchange, symbol, 'RTH', ro, rc FROM w), "
    "e AS (SELECT strftime(ts, '%H:%M') AS clock, value FROM events) SELECT exchange, symbol, session, count(*) AS n, round(sum(value), 2) + 0.0 AS value "
    "FROM s JOIN e ON CASE WHEN closes > opens THEN clock >= opens AND clock < closes ELSE clock >= opens OR clock < closes END GROUP BY ALL")  # fmt: skip


def _catalogue(spark, d):
    """Order days by kind of event: the catalogue's category, impact and time joined to the dates that follow from rules."""
    dates = cal.events(spark, 1992, 2001).select("date", "event")
    kinds = ins.event_catalogue(spark).select("event", "category", "impact", "time")
    return shown(order_days(spark, d).join(F.broadcast(dates), "date").join(F.broadcast(kinds), "event").groupBy("event", "category", "impact", "time").agg(F.count(F.lit(1)).alias("days"), F.sum("orders").alias("orders")))


add("event_catalogue", _catalogue,
    f"WITH {_MONTHS.replace('1995', '1992')}, {_DAYS}, k(event, category, impact, time) AS (VALUES ('nfp', 'macro', 'high', '08:30'), ('opex', 'options', 'medium', '16:00'), ('quad_witching', 'options', 'high', '16:00'), ('vix_expiration', 'options', 'medium', '09:00')), "
    f"f AS (SELECT {_NTH} AS f, month(m) IN (3, 6, 9, 12) AS q FROM m), e AS (SELECT f AS date, 'nfp' AS event FROM f UNION ALL SELECT f + 14, CASE WHEN q THEN 'quad_witching' ELSE 'opex' END FROM f UNION ALL SELECT f + 12, 'vix_expiration' FROM f) "
    "SELECT event, category, impact, time, count(*) AS days, CAST(sum(orders) AS BIGINT) AS orders FROM days JOIN e USING (date) JOIN k USING (event) GROUP BY ALL")  # fmt: skip
add("session_of_symbol", lambda s, d: shown(tf.session_filter(hourly(s, d), *ins.sessions_of("CL")["RTH"]).drop("symbol")),
    f"WITH bars AS ({intraday_sql(60)}) SELECT strftime(ts, '%Y-%m-%d %H:%M') AS ts, {', '.join(f'{rnd(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 540 AND 869")
_OPEX = "date_trunc('month', d) + INTERVAL 14 DAY"
add("annotate_events", lambda s, d: cal.annotate_events(daily(s, d).select(F.to_date("ts").alias("date")), s).select("date", F.concat_ws(",", "events").alias("events"), "high_impact"),
    f"WITH b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), x AS (SELECT d, dayofweek(d) AS w, day(d) AS n, month(d) AS m FROM b), "
    "y AS (SELECT d, w = 5 AND n BETWEEN 15 AND 21 AS o, w = 5 AND n <= 7 AS f, w = 3 AND n BETWEEN 13 AND 19 AS v, m IN (3, 6, 9, 12) AS q FROM x) "
    "SELECT d AS date, CASE WHEN o AND q THEN 'quad_witching' WHEN o THEN 'opex' WHEN f THEN 'nfp' WHEN v THEN 'vix_expiration' ELSE '' END AS events, (o AND q) OR f AS high_impact FROM y")  # fmt: skip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    missing = [f for f in REGISTRY if f"fn_{f}" not in QUERIES]
    if missing:
        raise LookupError(f"functions without a query: {missing}")
    return QUERIES | queries_long.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | queries_long.SQL
