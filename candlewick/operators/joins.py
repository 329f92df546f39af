"""As-of and interval joins of time-ordered tables.

``asof``: each left row meets the last right row at or before it. Both sides are one
table, sorted once by key and time in slices; the last right row so far is a running value,
so a key of any size is many tasks, and no left row is compared with more than one right row.

``within``: points meet the intervals that hold them. An interval is laid into cells of a
width near its own length, two at most; a point looks into one cell of each width that
occurs, so pairs meet in exactly one cell and the exact test follows. Widths are powers of
two, 63 at most, whatever the lengths.

Times are dates, timestamps (with or without zone) or whole numbers. A row whose key or time is
null meets nothing, as in any join; left rows and points are kept or dropped as ``how`` says. An
interval that ends before it starts, or lacks an end, holds nothing. Repeated rows join
repeatedly. Columns of the right side get ``prefix``; names must then be distinct, and names
that begin with ``_s_`` are used inside and refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import pin
from .slices import columns, running


def number(df: DataFrame, name: str) -> Column:
    """A time as a whole number that keeps the order: days, microseconds or the number itself."""
    kind = df.schema[name].dataType.typeName()
    c = F.col(f"`{name}`")
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c)
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind in ("byte", "short", "integer", "long"):
        return c.cast("long")
    raise TypeError(f"{name} is a {kind}, not a time or a whole number")


def _fit(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> list[str]:
    """The right side's columns without the keys, under their names in the result."""
    named = [prefix + c for c in right.columns if c not in keys]
    clash = set(named) & set(left.columns) | {c for c in [*left.columns, *right.columns] if c.startswith("_s_")}
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash; choose another prefix")
    return named


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, prefix: str = "right_", ties: Sequence[str] = (), strict: bool = False, tolerance: int | None = None, how: str = "left", slices: int | None = None) -> DataFrame:
    """``left`` with the columns of the last row of ``right`` that has the same keys and is not later.

    Of right rows at one time the last by the columns ``ties`` counts. ``strict`` takes only
    earlier rows; ``tolerance`` (days for dates, microseconds for timestamps) says how old a row may be.
    ``how`` is left or inner.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    _fit(left, right, keys, prefix)
    own = [c for c in right.columns if c not in keys]
    at_left, at_right = number(left, left_on), number(right, right_on)
    # One table: side 0 comes before side 1 at the same time, so a right row there counts unless ``strict``.
    given = F.struct(*columns(left.columns)).alias("_l"), F.lit(0 if strict else 1).alias("_side")
    asked = F.struct(at_right.alias("at"), F.struct(*columns(own)).alias("row")).alias("_r"), F.lit(1 if strict else 0).alias("_side")
    tie = F.struct(*columns(ties)) if ties else F.struct(F.lit(0).alias("none"))
    right_rows = right.filter(at_right.isNotNull()).select(*columns(keys), at_right.alias("_at"), asked[1], tie.alias("_tie"), asked[0])
    left_rows = left.select(*columns(keys), at_left.alias("_at"), given[1], F.lit(None).cast(right_rows.schema["_tie"].dataType).alias("_tie"), given[0])
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    found = running(both, keys, ["_at", "_side", "_tie"], {"_hit": ("last", F.col("_r"))}, slices).filter("_l is not null")
    good = F.col("_at").isNotNull() & F.col("_hit").isNotNull()
    for k in keys:
        good = good & F.col(f"`{k}`").isNotNull()
    if tolerance is not None:
        good = good & (F.col("_at") - F.col("_hit.at") <= tolerance)
    if how == "inner":
        found = found.filter(good)
    return found.select(*[F.col(f"_l.`{c}`").alias(c) for c in left.columns], *[F.when(good, F.col(f"_hit.row.`{c}`")).alias(prefix + c) for c in own])


def within(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, prefix: str = "", how: str = "inner", closed: bool = True) -> DataFrame:
    """``points`` with each interval of the same keys that holds them: start <= at <= end, or at < end if not ``closed``.

    ``how`` is inner, or left to keep points that no interval holds.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    _fit(points, intervals, keys, prefix)
    own = [c for c in intervals.columns if c not in keys]
    a, b, t = number(intervals, start), number(intervals, end), number(points, at)
    last = b if closed else b - 1
    # The width is the least power of two that is above the interval's length: it then reaches into two cells at most.
    level = F.length(F.bin(F.greatest(last - a, F.lit(0))))
    placed = intervals.withColumns({"_s_a": a, "_s_b": last}).filter("_s_a <= _s_b").withColumn("_s_level", level)
    cell = lambda c: F.call_function("shiftright", c, F.col("_s_level"))
    placed = placed.withColumn("_s_cell", F.explode(F.sequence(cell(F.col("_s_a")), cell(F.col("_s_b")))))
    levels = [r[0] for r in placed.select("_s_level").distinct().collect()]  # 63 at most
    right = placed.select(
        *[F.col(f"`{k}`").alias(f"_s_k{i}") for i, k in enumerate(keys)], F.col("_s_level").alias("_s_of"), F.col("_s_cell").alias("_s_in"), "_s_a", "_s_b", F.struct(*columns(own)).alias("_s_row")
    )
    left = points if how == "inner" else pin(points.withColumn("_s_id", F.monotonically_increasing_id()), "points")
    looked = left.withColumns({"_s_t": t, "_s_level": F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))}).withColumn("_s_cell", cell(F.col("_s_t")))
    same = (F.col("_s_level") == F.col("_s_of")) & (F.col("_s_cell") == F.col("_s_in")) & F.col("_s_t").between(F.col("_s_a"), F.col("_s_b"))
    for i, k in enumerate(keys):
        same = same & (F.col(f"`{k}`") == F.col(f"_s_k{i}"))
    pairs = looked.join(right, same)
    found = [*columns(points.columns), *[F.col(f"_s_row.`{c}`").alias(prefix + c) for c in own]]
    if how == "inner":
        return pairs.select(*found)
    pairs = pin(pairs.select(*found, "_s_id"), "pairs")
    alone = left.join(pairs.select("_s_id").distinct(), "_s_id", "left_anti")
    nothing = [F.lit(None).cast(intervals.schema[c].dataType).alias(prefix + c) for c in own]
    return pairs.drop("_s_id").unionByName(alone.select(*columns(points.columns), *nothing))
