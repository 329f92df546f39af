"""Calendars against a Python calendar, and bars from streams."""

import calendar
import datetime as dt

from pyspark.sql import functions as F

from candlewick.operators import market_calendar as cal
from candlewick.sources.bars import read_bars
from candlewick.streaming.bars import follow_files, stream_bars, stream_ema


def test_holidays(spark):
    found = {(r.date, r.holiday) for r in cal.holidays(spark, 2020, 2025).filter("exchange = 'CME'").collect()}
    for d, name in (("2024-03-29", "good_friday"), ("2024-01-15", "mlk_day"), ("2024-05-27", "memorial_day"), ("2024-11-28", "thanksgiving"), ("2024-11-29", "black_friday"), ("2021-07-05", "independence_day"), ("2022-06-20", "juneteenth"), ("2022-12-23", "christmas_eve"), ("2023-01-02", "new_year")):
        assert (dt.date.fromisoformat(d), name) in found
    assert not any(d == dt.date(2021, 12, 31) and name == "new_year" for d, name in found)


def test_events(spark):
    def nth(y, m, weekday, n):
        return [d for d in calendar.Calendar().itermonthdates(y, m) if d.month == m and d.weekday() == weekday][n - 1]

    got = {(r.date, r.event) for r in cal.events(spark, 2020, 2023).collect()}
    for y in range(2020, 2024):
        for m in range(1, 13):
            third = nth(y, m, 4, 3)
            assert (third, "quad_witching" if m % 3 == 0 else "opex") in got
            assert (nth(y, m, 4, 1), "nfp") in got and (third - dt.timedelta(days=2), "vix_expiration") in got


def test_annotations(spark):
    days = spark.createDataFrame([(dt.date(2024, 12, 25),), (dt.date(2024, 12, 24),), (dt.date(2024, 12, 20),), (dt.date(2024, 12, 22),)], "date date")
    rows = {r.date.day: r for r in cal.annotate_events(cal.annotate_holidays(days, spark), spark).collect()}
    assert (rows[25].day_type, rows[25].is_trading_day, rows[25].close_time) == ("closed", False, None)
    assert (rows[24].day_type, rows[24].close_time) == ("early_close", "13:15")
    assert rows[20].events == ["quad_witching"] and rows[20].high_impact and rows[20].close_time == "17:00"
    assert not rows[22].is_trading_day


def test_stream_of_bars(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, 9, m), float(m), m) for m in range(0, 60)] + [("A", dt.datetime(2024, 1, 1, 12), 1.0, 99)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double, seq int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts timestamp, price double, seq int").parquet(str(tmp_path / "in"))
    q = stream_bars(stream, 30).writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.ts.minute, r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars_out").collect())
    assert got == [(0, 0, 29, 0, 29, 30), (30, 30, 59, 30, 59, 30)]


def test_stream_of_means(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, 9, m), float(m)) for m in range(5)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, close double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts timestamp, close double").parquet(str(tmp_path / "in"))
    q = stream_ema(stream, 3).writeStream.format("memory").queryName("ema_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.ema for r in spark.table("ema_out").orderBy("ts").collect()] == [0, 0.5, 1.25, 2.125, 3.0625]


def test_files_are_followed_once(spark, make_bars, tmp_path):
    folder, root, state = (str(tmp_path / x) for x in ("in", "bars", "state"))
    make_bars([(1, 1, 1, 1, 1)], symbol="AA").write.parquet(folder)
    follow_files(spark, folder, root, state)
    make_bars([(2, 2, 2, 2, 2)], symbol="AA").write.mode("append").parquet(folder)
    follow_files(spark, folder, root, state)
    assert [r.close for r in read_bars(spark, root, "AA").collect()] == [2]
    assert read_bars(spark, root).filter(F.col("symbol") == "AA").count() == 1
