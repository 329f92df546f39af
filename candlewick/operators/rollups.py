"""Approximate aggregates that can be merged, and correlations of many series.

``sketches`` keeps, for each bucket of time and keys, a quantile sketch (KLL), a distinct
sketch (HyperLogLog) and exact counts, sums and extremes: a table some orders of magnitude
smaller than its rows. ``rolled_up`` merges buckets into longer ones and ``estimates`` reads
quantiles and distinct counts, without reading rows again. Merged sketches have the
error bound of one made from all rows: a KLL sketch of size k is off by about 1.65 / k^0.9 of rank, a
HyperLogLog of lg_k bits by about 1.04 / 2^(lg_k / 2) of the count.

``moments`` and ``correlations``: the series of a screen are pivoted by day; each task adds up the
outer products of its days, n by n numbers, and Spark adds these, so bars are never joined to
bars. Days on which one of a pair is missing do not count for that pair.

Nulls are left out of every aggregate; buckets without a value keep null sketches and count
as 0. NaN counts as null. Empty tables give no buckets and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 400
LG_K = 14
GRAINS = ("minute", "hour", "day", "week", "month", "quarter", "year")


def sketches(rows: DataFrame, keys: Sequence[str], ts: str, value: str, item: str, grain: str = "minute", k: int = K, lg_k: int = LG_K) -> DataFrame:
    """(keys, bucket, n, total, low, high, quantiles, distinct) by buckets of ``grain``."""
    if grain not in GRAINS:
        raise ValueError(f"grain is one of {', '.join(GRAINS)}")
    v = F.col(value).cast("double")
    given = rows.select(*keys, F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz").alias("bucket"), F.when(~F.isnan(v), v).alias("v"), F.col(item).alias("item"))
    return given.groupBy(*keys, "bucket").agg(
        F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.kll_sketch_agg_double("v", k).alias("quantiles"), F.hll_sketch_agg("item", lg_k).alias("distinct")
    )


def rolled_up(buckets: DataFrame, keys: Sequence[str], grain: str) -> DataFrame:
    """Buckets merged into those of a longer ``grain``, or over fewer ``keys``."""
    if grain not in GRAINS:
        raise ValueError(f"grain is one of {', '.join(GRAINS)}")
    merged = buckets.withColumn("bucket", F.date_trunc(grain, "bucket").cast("timestamp_ntz")).groupBy(*keys, "bucket")
    return merged.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def estimates(buckets: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Buckets with mean, distinct count and quantiles in place of sketches."""
    at = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q)))).alias(name) for name, q in shares.items()]
    kept = [c for c in buckets.columns if c not in ("quantiles", "distinct", "total")]
    return buckets.select(*kept, F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"), F.hll_sketch_estimate("distinct").alias("items"), *at)


def moments(rows: DataFrame, series: str, day: str, value: str, names: Sequence[str]) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) for each pair a < b of the series named: sums over days that both have.

    Of several rows of a series and day the mean counts. ``names`` is the screen, a list that the caller holds.
    """
    names = sorted(set(names))
    size = len(names)
    wide = rows.filter(F.col(series).isin(names)).groupBy(day).pivot(series, names).agg(F.avg(value)).select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss, sp = (np.zeros((size, size)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            have = (x == x).astype(float)
            x = np.where(x == x, x, 0.0)
            n += have.T @ have  # days that both have
            s += x.T @ have  # sum of a over these
            ss += (x * x).T @ have
            sp += x.T @ x
        a, b = np.triu_indices(size, 1)
        columns = [a, b, n[a, b].astype(np.int64), s[a, b], s[b, a], ss[a, b], ss[b, a], sp[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "n", "sa", "sb", "saa", "sbb", "sab"])

    parts = wide.mapInArrow(add, "i long, j long, n long, sa double, sb double, saa double, sbb double, sab double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    label = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return sums.select(F.element_at(label, (F.col("i") + 1).cast("int")).alias("a"), F.element_at(label, (F.col("j") + 1).cast("int")).alias("b"), "n", "sa", "sb", "saa", "sbb", "sab")


def correlations(rows: DataFrame, series: str, day: str, value: str, names: Sequence[str], least: int = 2) -> DataFrame:
    """(a, b, n, correlation) for each pair a < b with ``least`` common days; null where one side does not vary."""
    m = moments(rows, series, day, value, names).filter(F.col("n") >= least)
    n, c = F.col("n"), F.col
    below = F.sqrt((n * c("saa") - c("sa") * c("sa")) * (n * c("sbb") - c("sb") * c("sb")))
    return m.select("a", "b", "n", F.when(below > 0, (n * c("sab") - c("sa") * c("sb")) / below).alias("correlation"))


def screen(bars: DataFrame, tests: dict[str, Column], by: str = "symbol", ts: str = "ts") -> DataFrame:
    """One row for each series whose last row passes all ``tests`` (name -> condition), with how often each test has held."""
    held = bars.withColumns(tests)
    out = held.groupBy(by).agg(F.max(ts).alias(ts), *[F.max_by(F.coalesce(F.col(n), F.lit(False)), ts).alias(f"{n}_now") for n in tests], *[F.count_if(F.col(n)).alias(f"{n}_bars") for n in tests], F.count(F.lit(1)).alias("bars"))
    for n in tests:
        out = out.filter(f"`{n}_now`")
    return out.drop(*[f"{n}_now" for n in tests])
