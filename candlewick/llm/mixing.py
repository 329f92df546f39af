"""Operator 9: mixing sources to target weights by weighted fair queueing.

Each source's documents are put in an order given by a seeded hash. A copy of
a document gets a virtual finish time: the source's tokens up to and including
it, over the source's target. All copies, one for each epoch, form a queue that
is range-sorted by the middle of their virtual service (finish less half of
their own share), and cut where the total budget is spent. By the middle each
source is cut at the document whose end is nearest to its target, not always
before it.

Sizes are running sums of integers, so reruns agree exactly. A source may hold
any share of the rows: its running sums are made cell by cell (a cell is a
range of the order hash), those of the queue partition by partition of the
range sort, each with a table of totals; nothing is put in order in one task.

Null texts have size 0 and are never taken; a null source is a source of its
own, last in the order of sources; very long texts are documents like others,
a source is then off its target by at most half of one; repeated rows are
separate documents; an empty table gives no rows. Columns other than doc_id,
text and source are ignored, whatever they are called; ``mix_documents`` keeps
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, pin, text_key

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
CELL_ROWS = 20_000


def size_of(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source() -> Column:
    """A source's name, apart from null's."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """(src, source_size) and the source's target: weights share ``budget`` times all sizes, no target above ``epochs`` times its source.

    Sources in order of cap over weight are filled while the level of the rest
    lies above the cap; the level of the first that is not full holds for all after it.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), "src")
    t = (
        t.withColumn("rank", F.row_number().over(by_fill))
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(float(budget)) * F.sum("source_size").over(everything) - F.col("spent")) / F.col("rest"))
        .withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
        .withColumn("first", F.min(F.when(~F.col("full"), F.struct("rank", "level"))).over(everything))
    )
    full = F.col("first").isNull() | (F.col("rank") < F.col("first.rank"))
    return t.select("src", "source_size", F.when(full, F.col("cap")).otherwise(F.col("w") * F.col("first.level")).alias("target"))


def _cut(queue: DataFrame, budget: int) -> tuple[float, int]:
    """The last (time, order) of the range-sorted queue whose running total is within the budget."""
    parts = pin(queue.repartitionByRange("time", "order").withColumn("part", F.spark_partition_id()), "queue")
    totals = parts.groupBy("part").agg(F.sum("size").alias("n"))
    # One row for each partition of the sort.
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("time", "order").rowsBetween(Window.unboundedPreceding, 0)
    queued = parts.join(F.broadcast(before), "part").filter(F.col("before") <= budget).withColumn("total", F.col("before") + F.sum("size").over(inside))
    last = queued.filter(F.col("total") <= budget).agg(F.max(F.struct("time", "order")).alias("m")).first().m
    return (last.time, last.order) if last else (float("-inf"), 0)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = 1.5, epochs: int = 2, seed: int = 17, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: doc_id, tkey, src, size, source_size, target, times, order, finish, copies, taken.

    ``times`` and ``order`` are the copies' places in the queue, ``finish`` is the first copy's virtual finish time.
    """
    rows = docs.select("doc_id", "source", size_of("text").alias("size"), text_key().alias("tkey"))
    rows = rows.withColumn("src", _source())
    rows = pin(rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "tkey", "src")), "sizes")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    cells = max(1, -(-n // cell_rows))
    cell = F.least(F.floor((F.col("order").cast("double") / 2.0**64 + 0.5) * cells), F.lit(cells - 1))
    rows = rows.withColumn("cell", cell)
    by_cell = rows.groupBy("src", "source", "cell").agg(F.sum("size").alias("size"))
    by_source = by_cell.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    before = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_table = by_cell.select("src", "cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")).join(targets(by_source, weights, budget, epochs), "src")
    inside = Window.partitionBy("src", "cell").orderBy("order", F.col("doc_id").asc_nulls_first(), "tkey").rowsBetween(Window.unboundedPreceding, 0)
    timed = pin(
        rows.withColumn("run", F.sum("size").over(inside))
        .join(cell_table, ["src", "cell"])
        .select("doc_id", "tkey", "src", "size", "source_size", "target", "order", (F.col("offset") + F.col("run")).alias("run")),
        "times",
    )
    middle = [F.try_divide(F.col("run") - F.col("size") / 2 + F.col("source_size") * e, F.col("target")) for e in range(epochs)]
    queue = timed.filter("size > 0").select("size", "order", F.explode(F.array(*middle)).alias("time"))
    time, order = _cut(queue, int(total * budget))
    taken = [F.when((F.col("size") > 0) & ((m < time) | ((m == time) & (F.col("order") <= order))), 1).otherwise(0) for m in middle]
    copies = sum(taken[1:], taken[0])
    return timed.withColumn("copies", copies).select(
        "doc_id",
        "tkey",
        "src",
        "size",
        "source_size",
        "target",
        F.array(*middle).alias("times"),
        "order",
        F.try_divide(F.col("run"), F.col("target")).alias("finish"),
        F.col("copies").cast("int").alias("copies"),
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself in order of the queue: each document as often as the mix takes it, with the columns of ``docs``."""
    key = ["doc_id", "tkey", "src"]
    # Rows that are equal in all three share a list; it holds as many numbers as there are such rows.
    taken = mix(docs, **options).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("copies", "times", "order"))).alias("queued"))
    rows = boxed(docs, **{"id": F.col("doc_id"), "text": text_key(), "from": _source()})
    if rows.groupBy("id", "text", "from").count().filter("count > 1").limit(1).count():
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "text", "from").orderBy(F.lit(1))))
    else:
        rows = rows.withColumn("nth", F.lit(1))
    joined = rows.join(taken, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text") == F.col("tkey")) & (F.col("from") == F.col("src")))
    own = joined.select("row", F.element_at("queued", F.col("nth")).alias("own"))
    copies = own.select("row", "own.order", F.explode(F.slice("own.times", F.lit(1), F.col("own.copies"))).alias("time"))
    return copies.repartitionByRange("time", "order").sortWithinPartitions("time", "order").select("row.*")
