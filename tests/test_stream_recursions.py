"""Recursions over streams, cut into micro-batches anywhere, against the sorted pass."""

import datetime as dt
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.functions.kernels import Ema, Rma, Sar, Supertrend
from candlewick.plans.query import run_query
from candlewick.streaming.recursions import ROCKS, pack, stream_indicators, unpack

SCHEMA = "symbol string, ts timestamp, high double, low double, close double"
FAR = dt.datetime(2030, 1, 1)


def series(seed, n, lost):
    r, c, rows = random.Random(seed), 50.0, []
    for i in range(n):
        c = max(1.0, c + r.gauss(0, 1))
        row = [c + r.random(), c - r.random(), c]
        rows.append((dt.datetime(2024, 1, 1, 9) + dt.timedelta(minutes=i), *[None if r.random() < lost else x for x in row]))
    return rows


def test_kernels_go_on_from_packed_state():
    r = np.random.default_rng(1)
    x = r.normal(size=(4, 60)).cumsum(axis=1)
    x[:, 20:23] = np.nan
    high, low, close, atr = np.maximum.reduce([x[0], x[1], x[2]]), np.minimum.reduce([x[0], x[1], x[2]]), x[2], np.abs(x[3])
    for make, inputs in ((lambda: Ema(5), [close]), (lambda: Rma(4), [close]), (lambda: Supertrend(1.5), [high, low, close, atr]), (lambda: Sar(0.02, 0.2), [high, low, close, np.r_[close[1:], np.nan]])):
        whole = make()(*inputs)
        for cut in (1, 2, 19, 21, 40):
            first = make()
            a = first(*[v[:cut] for v in inputs])
            b = unpack(make(), pack(first))(*[v[cut:] for v in inputs])
            assert all(np.allclose([*p, *q], w, equal_nan=True) for p, q, w in zip(a, b, whole)), (make(), cut)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_micro_batches_equal_the_batch(spark, rocks, tmp_path, seed):
    r = random.Random(seed)
    data = {"A": series(seed, 60, 0.0), "B": series(seed + 10, 25, 0.1), "C": series(seed + 20, 2, 0.0)}
    rows = [(s, *row) for s, own in data.items() for row in own]
    rows.sort(key=lambda x: x[1] + dt.timedelta(minutes=r.randrange(0, 8)))  # out of order, within what is allowed
    cuts = sorted(r.sample(range(1, len(rows)), 4))
    folder = tmp_path / "in"
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
    spark.createDataFrame([("end", FAR, 1.0, 1.0, 1.0)], SCHEMA).coalesce(1).write.parquet(f"{folder}/9")

    # One source whose files come one batch at a time, in order.
    live = tmp_path / "live"
    live.mkdir()
    name = f"recursions_{seed}"
    stream = stream_indicators(spark.readStream.schema(SCHEMA).parquet(str(live)), 5, 4, 6, 2.0)
    out = str(tmp_path / "out")
    for i in [*range(len(cuts) + 1), 9, 10]:
        if i < 10:
            for f in (folder / str(i)).glob("*.parquet"):
                shutil.copy(f, live / f"{i}-{f.name}")
        else:
            spark.createDataFrame([("end", FAR + dt.timedelta(days=1), 1.0, 1.0, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(live))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).queryName(f"{name}_{i}").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out).filter("symbol <> 'end'").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    bars = spark.createDataFrame(rows, SCHEMA).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("close").alias("open"), "high", "low", "close", F.lit(1.0).alias("volume"))
    maps = {"ema": "ema(close, 5)", "rma": "rma(close, 4)", "atr": "atr(6)", "supertrend": "supertrend(6, 2.0)", "supertrend_dir": "supertrend_dir(6, 2.0)", "sar": "sar()"}
    want = run_query({"map": maps, "columns": ["symbol", "ts", *maps]}, bars, symbols=True).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert found.symbol.tolist() == want.symbol.tolist() and found.ts.tolist() == want.ts.tolist()
    for m in maps:
        assert np.allclose(found[m].astype(float), want[m].astype(float), rtol=1e-9, equal_nan=True), m


def test_the_session_must_have_the_state_store(spark):
    with pytest.raises(ValueError):
        stream_indicators(spark.readStream.format("rate").load().selectExpr("'a' as symbol", "timestamp as ts", "1.0 as high", "1.0 as low", "1.0 as close"))
