"""Merged sketches within their error bounds, and correlations against a pass over all pairs."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.operators import rollups as ru


@pytest.fixture(scope="module")
def ticks(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(0, 60 * 24 * 400)), r.choice([None, float("nan"), *[r.lognormvariate(0, 2)] * 8]), r.randrange(5000)) for _ in range(20_000)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double, item long").cache()


def test_rolled_up_sketches_keep_their_bounds(ticks):
    small = ru.sketches(ticks, ["k"], "ts", "v", "item", "hour")
    year = ru.rolled_up(ru.rolled_up(ru.rolled_up(small, ["k"], "day"), ["k"], "month"), ["k"], "year")
    shares = {"q01": 0.01, "median": 0.5, "q95": 0.95}
    found = {(r.k, r.bucket.year): r for r in ru.estimates(year, shares).collect()}
    frame = ticks.toPandas()
    frame["y"] = frame.ts.dt.year
    for key, own in frame.groupby(["k", "y"]):
        r, v = found[key], np.sort(own.v.dropna())
        assert r.n == len(v) and abs(r.mean - v.mean()) < 1e-9 * abs(v).sum() and (r.low, r.high) == (v[0], v[-1])
        for name, q in shares.items():
            assert abs(np.searchsorted(v, r[name], "right") / len(v) - q) < 3 * 1.65 / ru.K**0.9
        assert abs(r["items"] / own["item"].nunique() - 1) < 4 * 1.04 / 2 ** (ru.LG_K / 2)


def test_fewer_keys_and_no_rows(ticks):
    all_keys = ru.rolled_up(ru.sketches(ticks, ["k"], "ts", "v", "item", "month"), [], "year")
    assert sum(r.n for r in all_keys.collect()) == ticks.filter("v is not null and not isnan(v)").count()
    none = ru.estimates(ru.rolled_up(ru.sketches(ticks.filter("v is null"), ["k"], "ts", "v", "item"), ["k"], "year"), {"m": 0.5}).collect()
    assert none and all(r.n == 0 and r.m is None and r.mean is None for r in none)
    assert ru.sketches(ticks.limit(0), ["k"], "ts", "v", "item").collect() == []
    with pytest.raises(ValueError):
        ru.sketches(ticks, ["k"], "ts", "v", "item", "eon")


@pytest.fixture(scope="module")
def daily(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=90).cumsum()
    rows = []
    for name, weight in (("a.x", 1.0), ("b", 0.5), ("c", -0.8), ("flat", None), ("few", 0.0)):
        for d in range(90):
            if name == "few" and d > 1 or r.random() < 0.15:
                continue
            v = 3.0 if weight is None else weight * base[d] + r.normal()
            rows.append((name, d, float("nan") if r.random() < 0.05 else float(v)))
    return spark.createDataFrame(rows, "s string, day int, v double").withColumn("v", F.when(~F.isnan("v"), F.col("v"))).cache()


def test_correlations(daily):
    wide = daily.toPandas().pivot_table(index="day", columns="s", values="v")
    found = {(r.a, r.b): r for r in ru.correlations(daily, "s", "day", "v", ["b", "a.x", "c", "flat", "few", "absent"], 5).collect()}
    names = sorted(wide.columns)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = wide[[a, b]].dropna()
            if len(both) < 5:
                assert (a, b) not in found
                continue
            assert found[a, b].n == len(both)
            want = np.nan if "flat" in (a, b) else both[a].corr(both[b])
            got = found[a, b].correlation
            assert (got is None) == bool(pd.isna(want)) and (got is None or abs(got - want) < 1e-9)
    assert ru.correlations(daily.limit(0), "s", "day", "v", ["a", "b"]).collect() == []


def test_screen(daily):
    bars = daily.withColumnRenamed("s", "symbol").withColumnRenamed("day", "ts")
    found = {r.symbol: r for r in ru.screen(bars, {"up": F.col("v") > 0, "known": F.col("v").isNotNull()}).collect()}
    frame = bars.toPandas().sort_values("ts")
    for name, own in frame.groupby("symbol"):
        last = own.iloc[-1]
        assert (name in found) == (last.v > 0)
        if name in found:
            assert found[name].up_bars == (own.v > 0).sum() and found[name].bars == len(own)
