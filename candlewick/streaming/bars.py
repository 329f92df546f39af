"""Bars from streams: watermarked time buckets, gap sessions, and running means with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import bars as source
from ..sources import versions


def stream_bars(rows: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of (symbol, ts, price, seq): a bar comes out once no row for it can come any more."""
    order = F.struct("ts", "seq")
    return (
        rows.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def stream_sessions(rows: DataFrame, gap: str = "90 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream: runs of rows with no gap above ``gap``."""
    return (
        rows.withWatermark("ts", late)
        .groupBy("symbol", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min("price").alias("low"), F.max("price").alias("high"))
        .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "low", "high")
    )


def stream_ema(bars: DataFrame, n: int) -> DataFrame:
    """Each bar's exponential mean of close; the state is one number for each symbol.

    Bars of a symbol must come in order of time from batch to batch.
    """
    alpha = 2.0 / (n + 1)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for close in rows["close"]:
            mean = close if mean is None else (1 - alpha) * mean + alpha * close
            out.append(mean)
        state.update((mean,))
        yield pd.DataFrame({"symbol": rows["symbol"], "ts": rows["ts"], "close": rows["close"], "ema": out})

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, ema double", "mean double", "append", GroupStateTimeout.NoTimeout)


def follow_files(spark, folder: str, root: str, checkpoint: str, timeframe: str = "1d", asset_type: str = "futures") -> None:
    """Upsert every new Parquet file of bars in ``folder`` once, then stop."""
    _follow(spark, folder, checkpoint, lambda batch, _: source.append_bars(batch.sparkSession, root, batch, timeframe, asset_type))


def follow_versions(spark, folder: str, root: str, checkpoint: str, name: str = "files") -> None:
    """The same into a versioned table: a batch is all or nothing, and one that is run again after a failure is known by its number under ``name``."""
    _follow(spark, folder, checkpoint, lambda batch, number: None if batch.isEmpty() else versions.merge(batch.sparkSession, root, batch, (name, number)))


def _follow(spark, folder: str, checkpoint: str, each) -> None:
    stream = spark.readStream.schema(source.SCHEMA).parquet(folder)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
