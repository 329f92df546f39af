"""Long series cut into slices, so that a key's history is many tasks and not one.

``running`` and ``numbered``: rows are range-sorted by key and order and written once;
each slice of the sort adds up its own rows, and what lies before a slice is the sum
over the slices before it, of which there is one row each.

``windows``: rows are cut every ``rows`` rows of a key; a slice also gets the last
``back`` rows of the one before (and the first ``ahead`` rows of the one after), so a
frame of that reach never leaves its slice.

``scanned``: a linear recursion y = a * y' + b is an affine map of what came before.
Each slice composes its steps into one map, the maps of a key are applied in order (one
row a slice), and each slice then starts from the true value.

``ranked`` and ``quantiles``: distinct values are counted, then counts before each
value give ranks over a whole column, ties included, and exact quantiles.

No window here spans a whole key: a window's partition is a slice of a key, or one row
for each slice of a key, whose number is at most SLICES.

Nulls in keys are a key of their own. Rows that tie in ``order`` have no order among
themselves; give it a tie-breaker. An empty table gives an empty table of the same
columns. New columns have the names given; names that begin with ``_s_`` are used inside,
and a table that has one is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..sources.shared import pin
from .recursions import RECURSIONS

ROWS = 65_536
SLICES = 100_000
PART = ["_s_key", "_s_slice"]


def columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _key(keys: Sequence[str]) -> Column:
    """The keys as one value; unlike the columns themselves, structs with nulls are equal to each other, in joins too."""
    return F.struct(*columns(keys)) if keys else F.struct(F.lit(0).alias("all"))


def _refuse(df: DataFrame) -> None:
    taken = [c for c in df.columns if c.startswith("_s_")]
    if taken:
        raise ValueError(f"columns named {taken} are used inside")


def _earlier() -> WindowSpec:
    """The slices of a key before this one: one row each."""
    return Window.partitionBy("_s_key").orderBy("_s_slice").rowsBetween(Window.unboundedPreceding, -1)


def _sorted(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slices: int | None) -> DataFrame:
    """``df`` range-sorted and written once, with its key and the number of its slice: all later passes see the same slices."""
    _refuse(df)
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not 0 < n <= SLICES:
        raise ValueError(f"1 to {SLICES} slices")
    rows = df.repartitionByRange(n, *columns(keys), *order)
    return pin(rows.select("*", _key(keys).alias("_s_key"), F.spark_partition_id().alias("_s_slice")), "slices")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: dict[str, Column | tuple[str, Column]], slices: int | None = None) -> DataFrame:
    """``df`` with running values over the rows of the same keys, up to and with this one.

    ``values`` names a column and says what it holds: a Column is added up (null adds nothing, a sum of
    nothing is 0, sums of integers stay exact); ``("max", c)`` and ``("min", c)`` are the extremes so far;
    ``("last", c)`` is the last value that is not null, for which ``order`` must be names of columns, ascending.
    """
    kinds = {n: v if isinstance(v, tuple) else ("sum", v) for n, v in values.items()}
    rows = _sorted(df, keys, order, slices)
    ends = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "max": F.max, "min": F.min, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))}
    own = rows.groupBy(*PART).agg(*[ends[kind](c).alias(n) for n, (kind, c) in kinds.items()])
    merge = {"sum": lambda c: F.coalesce(F.sum(c).over(_earlier()), F.lit(0)), "max": lambda c: F.max(c).over(_earlier()), "min": lambda c: F.min(c).over(_earlier()), "last": lambda c: F.last(c, ignorenulls=True).over(_earlier())}
    before = F.struct(*[merge[kind](F.col(f"`{n}`")).alias(n) for n, (kind, _) in kinds.items()]).alias("_s_before")
    inside = Window.partitionBy(*PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(own.select(*PART, before), PART)
    both = {
        "sum": lambda c, b: F.coalesce(F.sum(c).over(inside), F.lit(0)) + b,
        "max": lambda c, b: F.greatest(F.max(c).over(inside), b),
        "min": lambda c, b: F.least(F.min(c).over(inside), b),
        "last": lambda c, b: F.coalesce(F.last(c, ignorenulls=True).over(inside), b),
    }
    return joined.select(*columns(df.columns), *[both[kind](c, F.col(f"_s_before.`{n}`")).alias(n) for n, (kind, c) in kinds.items()])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "row", slices: int | None = None) -> DataFrame:
    """``df`` with each row's number among the rows of its keys, from 1."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, slices)


def windows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], build: Callable[[DataFrame, list[Column]], DataFrame], back: int, ahead: int = 0, rows: int = ROWS) -> DataFrame:
    """``build(df, by)``: adds columns by windows partitioned by ``by`` that reach ``back`` rows back and ``ahead`` rows on.

    ``build`` must keep all rows. A slice has ``rows`` rows, or as many as the reach if that is more.
    """
    rows = max(rows, back, ahead, 1)
    at = numbered(df, keys, order, "_s_row")
    home, place = F.expr(f"(_s_row - 1) div {rows}"), F.expr(f"(_s_row - 1) % {rows}")
    copy = lambda part, own: F.struct(part.alias("slice"), F.lit(own).alias("own"))
    copies = [copy(home, True)]
    if back:
        copies.append(F.when(place >= rows - back, copy(home + 1, False)))
    if ahead:
        copies.append(F.when((place < ahead) & (home > 0), copy(home - 1, False)))
    spread = at.select(*columns(df.columns), F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())).alias("_s_copy"))
    spread = spread.select(*columns(df.columns), _key(keys).alias("_s_key"), F.col("_s_copy.slice").alias("_s_slice"), F.col("_s_copy.own").alias("_s_own"))
    return build(spread, columns(PART)).filter("_s_own").drop(*PART, "_s_own")


def scanned(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], outputs: dict[str, tuple], slices: int | None = None) -> DataFrame:
    """``df`` with one column for each recursion of ``outputs``: name -> (recursion, parameter, input column).

    Recursions are those of ``recursions.RECURSIONS``. Two passes over the slices of one sort: the
    first gives each slice's summary, the second starts each slice from what those before it leave.
    """
    rows = _sorted(df, keys, order, slices)
    part = [*keys, "_s_slice"]
    specs = [(RECURSIONS[kind](parameter), column) for kind, parameter, column in outputs.values()]
    # How many values each recursion has seen before a slice says where its seed ends.
    own = rows.groupBy(*PART).agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, (_, c) in enumerate(specs)])
    seen = own.select(*PART, F.array(*[F.coalesce(F.sum(f"n{i}").over(_earlier()), F.lit(0)) for i in range(len(specs))]).alias("_s_seen"))
    placed = rows.join(seen, PART).select(*columns(df.columns), "_s_slice", "_s_seen")
    names = placed.columns
    group, ins, at_seen = [names.index(k) for k in part], [names.index(c) for _, c in specs], names.index("_s_seen")

    def parts(batch: pa.RecordBatch) -> list[tuple[int, int, tuple]]:
        edges = np.zeros(batch.num_rows, bool)
        edges[0] = True
        for i in group:
            codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
            edges[1:] |= codes[1:] != codes[:-1]
        cuts = [*np.flatnonzero(edges).tolist(), batch.num_rows]
        return [(a, b, tuple(batch.column(i)[a].as_py() for i in group)) for a, b in zip(cuts, cuts[1:])]

    def values(batch: pa.RecordBatch, i: int, a: int, b: int) -> np.ndarray:
        return batch.column(ins[i]).slice(a, b - a).cast(pa.float64()).to_numpy(zero_copy_only=False)

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, sums, seen = None, None, [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[first.column(i) for i in group], pa.array([sums], pa.list_(pa.list_(pa.float64())))], made.names)

        for batch in batches:
            for a, b, this in parts(batch) if batch.num_rows else ():
                if this != current:
                    if current is not None:
                        yield row()
                    current, first, sums = this, batch.slice(a, 1), [r.summary() for r, _ in specs]
                    seen = batch.column(at_seen)[a].as_py()
                for i, (recursion, _) in enumerate(specs):
                    x = values(batch, i, a, b)
                    sums[i] = recursion.extend(sums[i], x, seen[i])
                    seen[i] += int(np.count_nonzero(x == x))
        if current is not None:
            yield row()

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the summaries of a key's slices, in order, to the state that each slice starts from."""
        current, states = None, []
        for batch in batches:
            out, at = [], [batch.column(i).to_pylist() for i in range(len(keys))]
            for k, sums in enumerate(batch.column(len(part)).to_pylist()):
                this = tuple(c[k] for c in at)
                if this != current:
                    current, states = this, [r.state() for r, _ in specs]
                out.append(states)
                states = [r.advance(s, m) for (r, _), s, m in zip(specs, states, sums)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(part)], pa.array(out, pa.list_(pa.list_(pa.float64())))], made.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states, seen = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[list[np.ndarray]] = [[] for _ in specs]
            for a, b, this in parts(batch):
                if this != current:
                    current, states, seen = this, batch.column(len(names))[a].as_py(), batch.column(at_seen)[a].as_py()
                for i, (recursion, _) in enumerate(specs):
                    x = values(batch, i, a, b)
                    y, states[i] = recursion.run(states[i], x, seen[i])
                    seen[i] += int(np.count_nonzero(x == x))
                    out[i].append(y)
            new = [pa.array(np.concatenate(o), from_pandas=True) for o in out]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *new], schema.names)

    kept = [i for i, n in enumerate(names) if n not in ("_s_slice", "_s_seen")]
    # Columns cross to Python by place, so that they may have any names.
    plain = lambda d: d.toDF(*[f"c{i}" for i in range(len(d.columns))])
    made = plain(placed.select(*columns(part), F.array(F.array(F.lit(0.0))))).schema
    dealt = lambda d: plain(d.repartition(*columns(part)).sortWithinPartitions(*columns(part), *order))
    sums = pin(dealt(placed).mapInArrow(summarize, made), "summaries").toDF(*part, "_s_start")
    by_key = sums.repartition(*columns(keys)) if keys else sums.repartition(1)  # one row for each slice of a key
    begins = pin(plain(by_key.sortWithinPartitions(*columns(part))).mapInArrow(starts, made), "starts").toDF(*part, "_s_start")
    keyed = lambda d: d.withColumn("_s_key", _key(keys))
    ready = keyed(placed).join(keyed(begins).select(*PART, "_s_start"), PART).select(*columns(names), "_s_start")
    schema = plain(df.select("*", *[F.lit(None).cast("double") for _ in outputs])).schema
    return dealt(ready).mapInArrow(walk, schema).toDF(*df.columns, *outputs)


def counted(df: DataFrame, keys: Sequence[str], value: str, slices: int | None = None) -> DataFrame:
    """(keys, value, n, upto): how often each value that is not null occurs for its keys, and how many rows are at or below it."""
    counts = df.filter(F.col(f"`{value}`").isNotNull()).groupBy(*columns([*keys, value])).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, keys, columns([value]), {"upto": F.col("n")}, slices)


def _shares(df: DataFrame, keys: Sequence[str], value: str, slices: int | None) -> DataFrame:
    counts = pin(counted(df, keys, value, slices).withColumn("_s_key", _key(keys)), "counts")
    return counts.join(counts.groupBy("_s_key").agg(F.max("upto").alias("_s_total")), "_s_key")


def ranked(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", slices: int | None = None) -> DataFrame:
    """``df`` with the share of its keys' values at or below each value; ties get their mean rank, null has none.

    Equal values are counted before anything is sorted, so a value that a third of all rows
    share is one row of the sort.
    """
    _refuse(df)
    middle = F.col("upto") - (F.col("n") - 1) / 2
    shares = _shares(df, keys, value, slices).select("_s_key", F.col(f"`{value}`").alias("_s_value"), (middle / F.col("_s_total")).alias(name))
    rows = df.select("*", _key(keys).alias("_s_key"), F.col(f"`{value}`").alias("_s_value"))
    return rows.join(shares, ["_s_key", "_s_value"], "left").drop("_s_key", "_s_value")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], slices: int | None = None) -> DataFrame:
    """One row for each of the keys that has values: exact quantiles, between two values by linear interpolation, under the names in ``shares``."""
    joined = _shares(df, keys, value, slices).withColumn("_s_below", F.col("upto") - F.col("n"))
    found = []
    for name, share in shares.items():
        if not 0 <= share <= 1:
            raise ValueError("a quantile lies between 0 and 1")
        at = F.lit(float(share)) * (F.col("_s_total") - 1)
        pick = lambda place: F.max(F.when((F.col("_s_below") <= place) & (place < F.col("upto")), F.col(f"`{value}`")))
        low, high, part = pick(F.floor(at)), pick(F.ceil(at)), F.max(at - F.floor(at))
        found.append(F.when(low == high, low).otherwise(low + (high - low) * part).alias(name))
    return joined.groupBy("_s_key").agg(*found).select(*[F.col(f"_s_key.`{k}`") for k in keys], *columns(list(shares)))
