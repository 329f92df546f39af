import json

from candlewick.sources import instruments as ins


def test_sessions():
    assert ins.sessions_of("nq") == {"ETH": ("18:00", "17:00"), "RTH": ("09:30", "16:15")} and ins.sessions_of("none") == {}
    rows = ins.session_rows()
    assert len({r[0] for r in rows}) == 31 and len(rows) == 62 == len(set(rows))


def test_minutes(spark):
    minutes = {(r.symbol, r.session): r.minutes for r in ins.sessions(spark).collect()}
    assert minutes["ES", "ETH"] == 1380 and minutes["ES", "RTH"] == 405 and minutes["ZC", "ETH"] == 1100 and minutes["KC", "RTH"] == 550


def test_instruments_and_their_events(spark):
    config = json.dumps({"sessions": {"RTH": ["09:30", "16:15"]}, "tick_size": 0.25, "tick_value": 5.0, "point_value": 20.0})
    rows = spark.createDataFrame([("nq", "Nasdaq", "CME", config, ["macro", "options"]), ("XX", None, None, None, None)], "symbol string, name string, exchange string, config string, events array<string>")
    table = {r.symbol: r for r in ins.instruments(rows).collect()}
    assert table["NQ"].sessions == {"RTH": ["09:30", "16:15"]} and (table["NQ"].tick_size, table["NQ"].type, table["NQ"].default_session) == (0.25, "futures", "RTH")
    assert table["XX"].events == ["macro"] and table["XX"].exchange == "" and table["XX"].sessions is None
    found = ins.instrument_events(ins.instruments(rows), spark).collect()
    assert len([r for r in found if r.symbol == "NQ"]) == 17 and len([r for r in found if r.symbol == "XX"]) == 14
    assert ins.event_catalogue(spark).count() == 31
