"""Instruments, their sessions and the kinds of events that concern them, as small dimension tables that join by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Exchange, symbols, electronic session, regular session (Eastern Time).
SESSIONS = """
CME     ES NQ RTY          18:00-17:00 09:30-16:15
CBOT    YM                 18:00-17:00 09:30-16:15
NYMEX   CL NG RB HO        18:00-17:00 09:00-14:30
COMEX   GC SI HG           18:00-17:00 08:20-13:30
NYMEX   PL                 18:00-17:00 08:20-13:30
CME     6E 6B 6J 6A 6C 6S  18:00-17:00 08:20-16:00
CBOT    ZN ZF ZT US        18:00-17:00 08:20-15:00
CME     BTC                18:00-17:00 09:30-16:00
CBOT    ZC ZW ZS           20:00-14:20 09:30-14:20
EUREX   FDAX FESX          19:15-16:00 03:00-11:30
ICEEUR  BRN                20:00-17:00 03:00-14:30
ICEUS   KC                 04:15-13:25 04:15-13:25
ICEUS   CC                 04:45-13:25 04:45-13:25
"""

# Event, category, impact, time of day (Eastern Time, - where there is none), schedule.
EVENTS = """
fomc                   macro    high    14:00  8x/year
nfp                    macro    high    08:30  1st Friday
cpi                    macro    high    08:30  monthly
ppi                    macro    medium  08:30  monthly
gdp                    macro    medium  08:30  quarterly
pce                    macro    high    08:30  monthly
retail_sales           macro    medium  08:30  monthly
jobless_claims         macro    low     08:30  Thursday
ism_manufacturing      macro    medium  10:00  1st biz day
ism_services           macro    medium  10:00  3rd biz day
consumer_confidence    macro    medium  10:00  monthly
michigan_sentiment     macro    medium  10:00  monthly
durable_goods          macro    medium  08:30  monthly
industrial_production  macro    low     09:15  monthly
eia_crude              oil      high    10:30  Wednesday
api_crude              oil      medium  16:30  Tuesday
opec                   oil      high    -      ~6x/year
baker_hughes           oil      low     13:00  Friday
btc_halving            crypto   high    -      ~4 years
etf_flows              crypto   medium  16:00  daily
token_unlocks          crypto   medium  -      varies
exchange_listing       crypto   medium  -      varies
earnings               stocks   high    -      quarterly
dividends_ex           stocks   medium  -      quarterly
stock_splits           stocks   medium  -      varies
index_rebalance        stocks   medium  -      quarterly
fda_decisions          stocks   high    -      varies
product_launches       stocks   medium  -      varies
opex                   options  medium  16:00  3rd Friday
quad_witching          options  high    16:00  3rd Fri Mar/Jun/Sep/Dec
vix_expiration         options  medium  09:00  Wed before 3rd Fri
"""

CONFIG = "sessions map<string,array<string>>, tick_size double, tick_value double, point_value double"


def session_rows() -> list[tuple[str, str, str, str, str]]:
    """(symbol, exchange, session, opens, closes)."""
    rows = []
    for line in SESSIONS.strip().splitlines():
        exchange, *symbols, electronic, regular = line.split()
        rows += [(s, exchange, name, *hours.split("-")) for s in symbols for name, hours in (("ETH", electronic), ("RTH", regular))]
    return rows


def sessions(spark: SparkSession) -> DataFrame:
    """(symbol, exchange, session, opens, closes, minutes) of the known instruments; a session may run over midnight."""
    rows = spark.createDataFrame(session_rows(), "symbol string, exchange string, session string, opens string, closes string")
    minute = lambda c: F.substring(c, 1, 2).cast("int") * 60 + F.substring(c, 4, 2).cast("int")
    return rows.withColumn("minutes", F.pmod(minute("closes") - minute("opens"), F.lit(1440)))


def sessions_of(symbol: str) -> dict[str, tuple[str, str]]:
    """The sessions of one symbol, as queries take them; none for an unknown one."""
    return {name: (start, end) for s, _, name, start, end in session_rows() if s == symbol.upper()}


def event_catalogue(spark: SparkSession) -> DataFrame:
    """(event, category, impact, time, schedule) of all kinds of events, also of those whose dates follow from no rule."""
    rows = [line.split(maxsplit=4) for line in EVENTS.strip().splitlines()]
    table = spark.createDataFrame(rows, "event string, category string, impact string, time string, schedule string")
    return table.withColumn("time", F.nullif(F.col("time"), F.lit("-")))


def instruments(rows: DataFrame) -> DataFrame:
    """Instrument rows, their ``config`` (JSON text) taken apart and what is missing filled in; the last row of a symbol must be the only one."""
    config = F.from_json("config", CONFIG)
    given = {c.lower() for c in rows.columns}
    text = lambda name, other: F.coalesce(F.col(name), F.lit(other)).alias(name) if name in given else F.lit(other).alias(name)
    events = F.col("events") if "events" in given else F.lit(None).cast("array<string>")
    return rows.select(
        F.upper("symbol").alias("symbol"),
        "name",
        text("exchange", ""),
        text("type", "futures"),
        text("category", ""),
        text("currency", "USD"),
        text("default_session", "RTH"),
        F.when(F.size(events) > 0, events).otherwise(F.array(F.lit("macro"))).alias("events"),
        *[config[c].alias(c) for c in ("tick_size", "tick_value", "point_value", "sessions")],
    )


def instrument_events(table: DataFrame, spark: SparkSession) -> DataFrame:
    """(symbol, event, category, impact): the kinds of events of each instrument's groups."""
    groups = table.select("symbol", F.explode("events").alias("category")).distinct()
    return groups.join(F.broadcast(event_catalogue(spark)), "category").select("symbol", "event", "category", "impact")  # 31 kinds
