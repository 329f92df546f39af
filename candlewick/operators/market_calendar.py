"""Market holidays and events as small dimension tables that join by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The days on which exchanges close, and when they close early.
US_CLOSED = ("new_year", "mlk_day", "presidents_day", "good_friday", "memorial_day", "juneteenth", "independence_day", "labor_day", "thanksgiving", "christmas")
US_EARLY = {"independence_day_eve": "13:15", "black_friday": "13:15", "christmas_eve": "13:15", "new_year_eve": "13:15"}
EU_CLOSED = ("new_year", "good_friday", "christmas")
EU_EARLY = {"christmas_eve": "12:30", "new_year_eve": "12:30"}
EXCHANGES = {"US": ("CME", "CBOT", "NYMEX", "COMEX", "ICEUS"), "EU": ("ICEEUR", "EUREX")}
REGULAR_CLOSE = "17:00"


def nth_weekday(first: Column, day: str, n: int) -> Column:
    """The n-th given weekday of the month that starts at ``first``; the last for n = -1."""
    if n < 0:
        return F.next_day(F.date_sub(F.last_day(first), 7), day)
    return F.date_add(F.next_day(F.date_sub(first, 1), day), 7 * (n - 1))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, in whole numbers."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, F.lit(100)), year % 100
    d, e = div(b, F.lit(4)), b % 4
    g = div(8 * b + 13, F.lit(25))
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, F.lit(4)), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = div(a + 11 * h + 22 * m, F.lit(451))
    x = h + m - 7 * n + 114
    return F.make_date(year.cast("int"), div(x, F.lit(31)).cast("int"), (x % 31 + 1).cast("int"))


def observed(day: Column) -> Column:
    """A Saturday's holiday is kept on Friday, a Sunday's on Monday."""
    return F.date_add(day, F.when(F.weekday(day) == 5, -1).when(F.weekday(day) == 6, 1).otherwise(0))


def friday_before(day: Column) -> Column:
    return F.date_sub(day, F.when(F.weekday(day) == 5, 1).when(F.weekday(day) == 6, 2).otherwise(0))


def rules(year: Column) -> dict[str, Column]:
    on = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))
    thanksgiving = nth_weekday(on(11, 1), "THU", 4)
    return {
        "new_year": observed(on(1, 1)),
        "mlk_day": nth_weekday(on(1, 1), "MON", 3),
        "presidents_day": nth_weekday(on(2, 1), "MON", 3),
        "good_friday": F.date_sub(easter(year), 2),
        "memorial_day": nth_weekday(on(5, 1), "MON", -1),
        "juneteenth": observed(on(6, 19)),
        "independence_day": observed(on(7, 4)),
        "labor_day": nth_weekday(on(9, 1), "MON", 1),
        "thanksgiving": thanksgiving,
        "christmas": observed(on(12, 25)),
        "independence_day_eve": friday_before(on(7, 3)),
        "black_friday": F.date_add(thanksgiving, 1),
        "christmas_eve": friday_before(on(12, 24)),
        "new_year_eve": friday_before(on(12, 31)),
    }


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(exchange, date, holiday, day_type, close_time) of some years. A date counts only in its own year's rules."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    entries = []
    found = rules(F.col("year"))
    for region, closed, early in (("US", US_CLOSED, US_EARLY), ("EU", EU_CLOSED, EU_EARLY)):
        for name in (*closed, *early):
            kind = ("closed", None) if name in closed else ("early_close", early[name])
            entries.append(F.struct(F.lit(region).alias("region"), found[name].alias("date"), F.lit(name).alias("holiday"), F.lit(kind[0]).alias("day_type"), F.lit(kind[1]).cast("string").alias("close_time")))
    rows = years.select("year", F.explode(F.array(*entries)).alias("e")).select("year", "e.*").filter(F.year("date") == F.col("year"))
    who = F.when(F.col("region") == "US", F.array(*map(F.lit, EXCHANGES["US"]))).otherwise(F.array(*map(F.lit, EXCHANGES["EU"])))
    return rows.select(F.explode(who).alias("exchange"), "date", "holiday", "day_type", "close_time")


def annotate_holidays(days: DataFrame, spark: SparkSession, exchange: str = "CME", date: str = "date", first_year: int = 1990, last_year: int = 2060) -> DataFrame:
    """Days with holiday, day_type (regular, closed, early_close), close_time and is_trading_day."""
    table = holidays(spark, first_year, last_year).filter(F.col("exchange") == exchange).drop("exchange").withColumnRenamed("date", "__d")
    one = table.groupBy("__d").agg(F.min_by("holiday", "day_type").alias("holiday"), F.min("day_type").alias("day_type"), F.min_by("close_time", "day_type").alias("close_time"))
    out = days.join(F.broadcast(one), F.col(date) == F.col("__d"), "left").drop("__d")  # at most 14 rows a year
    kind = F.coalesce("day_type", F.lit("regular"))
    return out.withColumns(
        {
            "day_type": kind,
            "close_time": F.when(kind == "closed", F.lit(None).cast("string")).otherwise(F.coalesce("close_time", F.lit(REGULAR_CLOSE))),
            "is_trading_day": (F.weekday(F.col(date)) < 5) & (kind != "closed"),
        }
    )


def events(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(date, event, category, impact): expirations and payrolls, which follow from the calendar."""
    first = F.make_date((F.col("id") / 12).cast("int"), (F.col("id") % 12 + 1).cast("int"), F.lit(1))
    months = spark.range(first_year * 12, last_year * 12 + 12).select(first.alias("m"))
    third, witching = nth_weekday(F.col("m"), "FRI", 3), F.month("m").isin(3, 6, 9, 12)
    one = lambda date, name, category, impact: F.struct(date.alias("date"), F.lit(name).alias("event"), F.lit(category).alias("category"), F.lit(impact).alias("impact"))
    found = F.array(
        F.when(~witching, one(third, "opex", "options", "medium")).otherwise(one(third, "quad_witching", "options", "high")),
        one(nth_weekday(F.col("m"), "FRI", 1), "nfp", "macro", "high"),
        one(F.date_sub(third, 2), "vix_expiration", "options", "medium"),
    )
    return months.select(F.explode(found).alias("e")).select("e.*")


def event_dates(spark: SparkSession, event: str, first: str, last: str) -> DataFrame:
    """Dates of one event in a range; opex includes the quarterly expirations, unknown events have none."""
    name = {"vix_exp": "vix_expiration"}.get(event.lower(), event.lower())
    names = ["opex", "quad_witching"] if name == "opex" else [name]
    table = events(spark, int(first[:4]), int(last[:4]))
    return table.filter(F.col("event").isin(names) & F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select("date").orderBy("date")


def annotate_events(days: DataFrame, spark: SparkSession, categories: list[str] | None = None, date: str = "date", first_year: int = 1990, last_year: int = 2060) -> DataFrame:
    """Days with the events on them, of some categories, and whether one has high impact."""
    table = events(spark, first_year, last_year)
    if categories is not None:
        table = table.filter(F.col("category").isin(categories))
    by_day = table.groupBy(F.col("date").alias("__d")).agg(F.array_sort(F.collect_set("event")).alias("events"), F.max(F.col("impact") == "high").alias("high_impact"))
    out = days.join(F.broadcast(by_day), F.col(date) == F.col("__d"), "left").drop("__d")  # at most 3 rows a month
    return out.withColumns({"events": F.coalesce("events", F.array().cast("array<string>")), "high_impact": F.coalesce("high_impact", F.lit(False))})


def session_profile(bars: DataFrame) -> DataFrame:
    """Bars and volume by minute of the day, and the longest run of minutes without a bar before each."""
    from .timeframes import minute_of_day

    used = bars.groupBy("symbol", minute_of_day(F.col("ts")).alias("minute")).agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))
    from pyspark.sql.window import Window

    return used.withColumn("empty_before", F.col("minute") - F.coalesce(F.lag("minute").over(Window.partitionBy("symbol").orderBy("minute")), F.lit(-1)) - 1)


def compare_daily(daily: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Both sides' closes by symbol and date, and their difference; a day that only one side has is kept."""
    a = daily.select("symbol", F.to_date("ts").alias("date"), F.col("close").alias("close_a"))
    b = rebuilt.select("symbol", F.to_date("ts").alias("date"), F.col("close").alias("close_b"))
    return a.join(b, ["symbol", "date"], "full_outer").withColumn("diff", F.col("close_a") - F.col("close_b"))
