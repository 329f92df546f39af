"""Operator 10: shards of nearly equal bytes by Karmarkar-Karp differencing.

Documents with equal texts form one group that is never divided. Groups are
dealt by hash into cells of bounded size; in each cell the differencing method
repeatedly merges the two partial partitions of largest spread, the heavy
parts of one onto the light parts of the other. A cell's result is itself a
partial partition, so the same step merges cells, ``fan_in`` at a time, until
one partition is left. No task sees more than a cell and the driver sees
nothing but the number of cells.

Null texts form one group of their own with size 1 each; repeated rows are
separate rows of one group; an empty table gives no rows. Other columns of the
input are ignored. A group's size is indivisible: one that holds a third of
all bytes makes its shard as large.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import pin, text_key

CELL_ROWS = 40_000
FAN_IN = 512


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge partial partitions (rows of part sums) into one.

    Returns ``place[i, p]``, the final part of part ``p`` of row ``i``, and the
    final sums by part. Ties go by row order, so equal input gives equal output.
    """
    n, k = vectors.shape
    if n == 0:
        return np.zeros((0, k), int), np.zeros(k, np.int64)
    place = np.zeros((n, k), int)
    # A node of the merge tree is a row, or a pair of nodes with the part of the first and of the second at each slot.
    nodes: list[tuple] = []
    heap = []
    for i in range(n):
        order = np.argsort(vectors[i], kind="stable")
        sums = vectors[i][order].tolist()
        nodes.append((i, order.tolist()))
        heap.append((sums[0] - sums[-1], i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        merged = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(k), key=merged.__getitem__)
        sums = [merged[j] for j in order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (sums[0] - sums[-1], len(nodes) - 1, sums))
    stack = [(len(nodes) - 1, list(range(k)))]
    while stack:
        node, final = stack.pop()
        if len(nodes[node]) == 2:
            row, order = nodes[node]
            place[row, order] = final
        else:
            a, b, order = nodes[node]
            at_a, at_b = [0] * k, [0] * k
            for slot, j in enumerate(order):
                at_a[j] = final[slot]
                at_b[k - 1 - j] = final[slot]
            stack += [(a, at_a), (b, at_b)]
    totals = np.zeros(k, np.int64)
    np.add.at(totals, place.ravel(), vectors.ravel())
    return place, totals


def _balance(groups: DataFrame, n_shards: int, cells: int, fan_in: int) -> DataFrame:
    """(gkey, shard) for (gkey, gsize)."""

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gsize", "gkey"], ascending=[False, True], ignore_index=True)
        v = np.zeros((len(pdf), n_shards), np.int64)
        v[:, -1] = pdf.gsize
        place, totals = difference(v)
        return pd.DataFrame({"gkey": pdf.gkey, "unit": pdf.cell, "part": place[:, -1].astype("int32"), "sums": [totals.tolist()] * len(pdf)})

    placed = pin(
        groups.withColumn("cell", F.pmod(F.xxhash64("gkey"), F.lit(cells)))
        .groupBy("cell")
        .applyInPandas(cell, "gkey string, unit long, part int, sums array<long>"),
        "cells",
    )
    units = placed.groupBy("unit").agg(F.first("sums").alias("sums"))
    maps, n = [], cells
    while n > 1:

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("unit", ignore_index=True)
            place, totals = difference(np.array(pdf.sums.tolist(), np.int64).reshape(len(pdf), n_shards))
            return pd.DataFrame({"unit": pdf.unit, "up": pdf.up, "place": place.astype("int32").tolist(), "sums": [totals.tolist()] * len(pdf)})

        level = pin(
            units.withColumn("up", F.expr(f"unit div {fan_in}")).groupBy("up").applyInPandas(merge, "unit long, up long, place array<int>, sums array<long>"),
            "merge",
        )
        maps.append(level.select("unit", "up", "place"))
        units = level.groupBy(F.col("up").alias("unit")).agg(F.first("sums").alias("sums"))
        n = -(-n // fan_in)
    out = placed.select("gkey", "unit", "part")
    for level in maps:
        out = out.join(level, "unit").select("gkey", F.col("up").alias("unit"), F.element_at("place", F.col("part") + 1).alias("part"))
    return out.select("gkey", F.col("part").alias("shard"))


def shard(docs: DataFrame, n_shards: int = 16, cell_rows: int = CELL_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, gkey, shard, slot.

    ``slot`` numbers a shard's rows from 0 without gaps, in an order that
    depends on the rows only.
    """
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        text_key().alias("gkey"),
    )
    rows = pin(rows, "sizes")
    n = rows.count()
    cells = max(1, -(-n // cell_rows))
    groups = rows.groupBy("gkey").agg(F.sum("size").alias("gsize"))
    shards = _balance(groups, n_shards, cells, fan_in)
    placed = rows.join(shards, "gkey").withColumn("cell", F.pmod(F.xxhash64("doc_id", "gkey"), F.lit(cells * 4)))
    placed = pin(placed, "placed")
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "gkey")
    return (
        placed.withColumn("nth", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "gkey", F.col("shard").cast(T.IntegerType()).alias("shard"), (F.col("offset") + F.col("nth")).cast("long").alias("slot"))
    )
