"""The query language: order of work, periods, sessions, steps, shapes and errors."""

import datetime as dt

import pytest

from candlewick.errors import QueryError, ValidationErrors
from candlewick.plans import response
from candlewick.plans.query import alias, plan, route, run_query, split_select, validate
from candlewick.sources.bars import append_bars, clean, read_bars, write_bars


@pytest.fixture(scope="module")
def hours(make_bars):
    return make_bars([(i, i + 1, i - 1, i + 0.5, 1) for i in range(24 * 9)], start=dt.datetime(2024, 1, 1), minutes=60)


def test_period_and_session(hours):
    sessions = {"DAY": ("09:00", "16:00"), "NIGHT": ("18:00", "17:00")}
    assert run_query({"session": "day", "period": "2024-01-02"}, hours, sessions=sessions).count() == 7
    assert run_query({"session": "NIGHT", "period": "2024-01-02"}, hours, sessions=sessions).count() == 23
    assert run_query({"period": "2024-01-03:2024-01"}, hours).count() == 24 * 7
    assert run_query({"period": "last_2"}, hours).count() == 48
    assert run_query({"period": "last_week"}, hours).count() == 24 * 7 + 1
    p = plan({"session": "moon"}, hours, sessions)
    assert p.warnings and p.result.count() == 216
    with pytest.raises(QueryError):
        run_query({"period": "2024-13"}, hours)


def test_fixed_periods_reach_the_scan(spark, hours, tmp_path):
    hours.write.parquet(str(tmp_path / "b"))
    df = run_query({"period": "2024-01-02", "columns": ["close"]}, clean(spark.read.parquet(str(tmp_path / "b"))))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text and "volume" not in text.split("ReadSchema")[1]


def test_weekly_label_is_sunday(hours):
    rows = run_query({"from": "weekly"}, hours).collect()
    assert [r.ts for r in rows if r.open == 0] == [dt.datetime(2024, 1, 7)]
    assert run_query({"from": "monthly"}, hours).first().ts == dt.datetime(2024, 1, 31)


def test_where_sees_unfiltered_windows(hours):
    got = run_query({"map": {"p": "prev(close)"}, "where": "hour() == 5", "columns": ["close", "p"]}, hours).first()
    assert got.close - got.p == 1


def test_group_steps_and_shapes(hours):
    q = {"steps": [{"from": "daily", "map": {"d": "dayofweek()"}}, {"group_by": "d", "select": "count(), mean(close)"}]}
    rows = run_query(q, hours).collect()
    assert [r.d for r in rows] == list(range(7)) and rows[0]["count"] == 2
    assert plan({"select": "max(high)"}, hours).kind == "scalar"
    assert plan({"select": "max(high), min(low)"}, hours).kind == "dict"
    with pytest.raises(QueryError):
        run_query({"steps": [{"map": {"d": "hour()"}, "group_by": "d"}, {"map": {"h": "hour()"}}]}, hours)


def test_names_and_splitting():
    assert split_select("count(), percentile(x, 0.9), max(high)") == ["count()", "percentile(x, 0.9)", "max(high)"]
    assert [alias(s) for s in ("count()", "mean(r)", "percentile(x, 0.9)", "max(a) - min(b)")] == ["count", "mean_r", "percentile_x", "max(a) - min(b)"]


def test_all_errors_at_once():
    with pytest.raises(ValidationErrors) as e:
        validate({"from": "3m", "map": {"a": "sma(close)", "b": "x = 1"}, "limit": 0, "join": 1, "group_by": "year()"})
    assert {x["step"] for x in e.value.errors} == {"from", "map", "limit", "query", "group_by"}


def test_routes():
    sessions = {"RTH": ("09:30", "16:00"), "ETH": ("18:00", "17:00")}
    assert route({"from": "5m"}) == "1m" and route({}) == "1d"
    assert route({"session": "rth"}, sessions) == "1m" and route({"session": "ETH"}, sessions) == "1d"


def test_envelope(hours):
    out = response.respond({"from": "daily", "map": {"dow": "dayofweek()", "r": "range()"}, "group_by": "dow", "select": "mean(r)"}, hours)
    assert out["table"][0]["dow"] == "Monday" and out["source_row_count"] == 9 and out["chart"] == {"category": "dow", "value": "mean_r"}
    assert response.describe(out).startswith("7 rows by dow")
    whole = response.respond({"from": "daily"}, hours)
    out = response.respond({"from": "daily"}, hours, rows=3)
    assert len(out["table"]) == 3 and out["summary"]["rows"] == len(whole["table"]) > 3 and out["summary"]["last"] == whole["table"][-1:]
    out = response.respond({"select": "max(high)"}, hours)
    assert out["summary"] == {"type": "scalar", "value": 216.0}


def test_upsert_and_partitions(spark, make_bars, tmp_path):
    root = str(tmp_path / "bars")
    a = make_bars([(1, 2, 0, 1, 1), (2, 3, 1, 2, 1)], symbol="AA")
    write_bars(a.union(make_bars([(9, 9, 9, 9, 9)], symbol="BB")), root)
    append_bars(spark, root, make_bars([(5, 5, 5, 5, 5), (6, 6, 6, 6, 6)], symbol="AA", start=dt.datetime(2024, 1, 2)))
    rows = read_bars(spark, root, "aa").orderBy("ts").collect()
    assert [(r.ts.day, r.close) for r in rows] == [(1, 1), (2, 5), (3, 6)]
    assert read_bars(spark, root, "BB").count() == 1
