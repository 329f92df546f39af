"""Bars: schema, readers, writers with upsert, and bars derived from event tables.

A bar table has symbol, ts (timestamp without zone), open, high, low, close and
volume as doubles. At rest it is partitioned by timeframe, asset_type and
symbol; missing values are null, never NaN.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PRICES = ("open", "high", "low", "close", "volume")
SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in PRICES]])


def clean(df: DataFrame) -> DataFrame:
    """The seven columns with their types, NaN as null."""
    prices = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in PRICES]
    return df.select(F.col("symbol").cast("string").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), *prices)


def read_bars(spark: SparkSession, root: str, symbol: str | None = None, timeframe: str = "1d", asset_type: str = "futures") -> DataFrame:
    """One symbol's bars, or all of a timeframe and type. Only the partitions asked for are listed and read."""
    df = spark.read.parquet(root).filter((F.col("timeframe") == timeframe) & (F.col("asset_type") == asset_type))
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol.upper())
    return clean(df)


def read_daily_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Headerless daily text: date, open, high, low, close, volume, open interest (not kept)."""
    raw = spark.read.csv(path, header=False, schema="d string, open double, high double, low double, close double, volume double, oi double")
    return clean(raw.select(F.lit(symbol.upper()).alias("symbol"), F.to_timestamp_ntz("d", F.lit("MM/dd/yyyy")).alias("ts"), *PRICES))


def read_minute_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Headerless minute text: date with time, open, high, low, close, volume."""
    raw = spark.read.csv(path, header=False, schema="t string, open double, high double, low double, close double, volume double")
    return clean(raw.select(F.lit(symbol.upper()).alias("symbol"), F.to_timestamp_ntz("t", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), *PRICES))


def read_zipped(spark: SparkSession, path: str, rename: dict[str, str] | None = None, daily: bool = True) -> DataFrame:
    """Bars of zip archives of headerless text files, one file a ticker.

    ``rename`` maps tickers to symbols and is also the allow-list. Archives are
    unpacked member by member on the executors.
    """
    import io
    import zipfile

    names = dict(rename) if rename else None
    n = 6 if daily else 5

    def unpack(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        ticker = member.rsplit("/", 1)[-1].split(".")[0].split("_")[0]
                        if names is not None and ticker not in names:
                            continue
                        with archive.open(member) as f:
                            for part in pd.read_csv(f, header=None, usecols=range(n + (not daily)), chunksize=100_000):
                                part = part.iloc[:, :6]
                                part.columns = ["t", *PRICES]
                                part["t"] = part["t"].astype(str)
                                part.insert(0, "symbol", names[ticker] if names else ticker.upper())
                                yield part.astype({c: "float64" for c in PRICES})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "symbol string, t string, " + ", ".join(f"{c} double" for c in PRICES))
    return clean(rows.withColumn("ts", F.coalesce(F.try_to_timestamp("t", F.lit("MM/dd/yyyy")), F.try_to_timestamp("t", F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, one for each symbol and ts: the new one where both have it, the last of equals otherwise."""
    both = clean(old).withColumn("__new", F.lit(0)).unionByName(clean(new).withColumn("__new", F.lit(1)))
    latest = Window.partitionBy("symbol", "ts").orderBy(F.col("__new").desc(), *[F.col(c).desc() for c in PRICES])
    return both.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__new", "__n")


def write_bars(df: DataFrame, root: str, timeframe: str = "1d", asset_type: str = "futures") -> None:
    """Replace the symbols in ``df``, and no others, in the partitioned table."""
    keyed = clean(df).withColumns({"timeframe": F.lit(timeframe), "asset_type": F.lit(asset_type)})
    writer = keyed.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("timeframe", "asset_type", "symbol").parquet(root)


def append_bars(spark: SparkSession, root: str, new: DataFrame, timeframe: str = "1d", asset_type: str = "futures") -> None:
    """Upsert ``new`` into the table at ``root``: only the partitions of its symbols are read and rewritten.

    The merged rows go to a folder beside the table first, since Spark cannot
    overwrite what it is reading; it is deleted afterwards. A job that is killed in between leaves
    that folder, and may leave symbols of both states: ``versions.merge`` is all or nothing.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return write_bars(upsert(new.limit(0), new), root, timeframe, asset_type)
    symbols = new.select("symbol").distinct()
    old = clean(spark.read.parquet(root).filter((F.col("timeframe") == timeframe) & (F.col("asset_type") == asset_type)).join(symbols, "symbol", "left_semi"))
    side = f"{root.rstrip('/')}.merge-{uuid.uuid4().hex}"
    upsert(old, new).write.parquet(side)
    write_bars(spark.read.parquet(side), root, timeframe, asset_type)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(side), True)


def is_newer(mark: str | None, remote: str) -> bool:
    """Whether a remote update date differs from the one that was processed last."""
    return mark is None or mark.strip() != remote.strip()


def ohlc_json(bars: DataFrame) -> DataFrame:
    """Daily bars as JSON lines."""
    day = bars.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"))
    return day.orderBy("symbol", "date").select(F.to_json(F.struct("date", "open", "high", "low", "close", "volume")).alias("value"))


def bars_from(rows: DataFrame, symbol: Column, bucket: Column, price: Column, order: list[Column]) -> DataFrame:
    """Bars of priced rows: the first and last price of a bucket go by ``order``; volume counts rows."""
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return (
        rows.select(symbol.alias("symbol"), bucket.cast("timestamp_ntz").alias("ts"), price.cast("double").alias("p"), at.alias("at"))
        .groupBy("symbol", "ts")
        .agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    )


def order_bars(spark: SparkSession, sf_dir: str, by_priority: bool = False) -> DataFrame:
    """Daily bars of order prices, as one series or one for each priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    symbol = F.col("o_orderpriority") if by_priority else F.lit("ALL")
    return bars_from(orders, symbol, F.col("o_orderdate"), F.col("o_totalprice"), [F.col("o_orderkey")])


def event_bars(spark: SparkSession, sf_dir: str, minutes: int = 60, by_type: bool = False) -> DataFrame:
    """Intraday bars of event values, as one series or one for each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    symbol = F.col("event_type") if by_type else F.lit("ALL")
    bucket = F.window("ts", f"{minutes} minutes").start
    return bars_from(events, symbol, bucket, F.col("value"), [F.col("ts"), F.col("event_id")])


def ticks(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """Every event as a bar of its own."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = F.col("value")
    return clean(events.select((F.col("event_type") if by_type else F.lit("ALL")).alias("symbol"), "ts", p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), F.lit(1.0).alias("volume")))
