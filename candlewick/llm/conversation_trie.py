"""Operator 13: the trie of conversation prefixes by preorder intervals.

A node is a distinct sequence of first turns (role and text); a conversation is a member
of the nodes it passes, from the root (no turn) on. Nodes are found without a
task that holds a whole conversation or a whole node's members:

1. Turns are numbered by running counts over one range sort, so a conversation
   of any length is spread over slices.
2. A node's name is a running sum along the conversation of 128-bit digests of
   (depth, role, text), kept as four sums of 32-bit words: prefixes are equal if and
   only if depth and sums are. Members, children and smallest member are counts by name.
3. A node's path is the digests of the turns at which its conversation takes one of
   several ways. Sorted by path and depth, nodes stand in preorder and each subtree is an
   interval. Beside each path stands a row that sorts behind all that begin with it: the
   interval's end. Running sums of leaves and of savings at both ends give those of
   every subtree by difference.

A conversation's forks are one array in one row, as many as there are other
conversations leaving it. The digest of the members that end at a node is
defined over one joined string, so it is made in one task for a node, streaming
over sorted ids in constant memory.

Turns are in order of turn, null first, then role and text; null roles and texts
are empty. Rows without a conv_id belong to no conversation and are left out. Repeated
rows are turns of their own. Texts of any length are hashed where they are read. Other
columns are ignored, whatever they are called; without conversations there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.slices import numbered, running
from .common import pin

GROUP = 100
MOST = 6
_WORDS = ["s1", "s2", "s3", "s4"]
_LAST = 2**62


def turns(conversations: DataFrame, slices: int | None = None) -> DataFrame:
    """(conv_id, at, code, chars): each turn's place from 0, the digest of its role and text, and the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    placed = numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "row", slices)
    code = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    return placed.select("conv_id", (F.col("row") - 1).alias("at"), code.alias("code"), F.length("text").cast("long").alias("chars"))


def spliced(found: DataFrame, group: int = GROUP, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on a shared start: h turns of the first of their ``group`` of ids, then their own after the first h.

    h is the crc32 of the id as text modulo ``most``; ids below 0 are grouped towards 0. Gives members (conv_id, length) and their
    turns (conv_id, depth, code, chars, last), depth from 1.
    """
    found = pin(found, "turns")
    sizes = found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = sizes.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = sizes.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "base": F.col("conv_id") - F.col("conv_id") % group})
    convs = convs.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = pin(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "members")
    first = found.filter((F.col("conv_id") % group == 0) & (F.col("at") < most - 1)).withColumnRenamed("conv_id", "base")
    start = first.join(convs, "base").filter("at < taken").withColumn("depth", F.col("at") + 1)
    rest = found.join(convs, "conv_id").filter("at >= h").withColumn("depth", F.col("taken") + F.col("at") - F.col("h") + 1)
    parts = [x.select("conv_id", "depth", "code", "chars", (F.col("depth") == F.col("length")).alias("last")) for x in (start, rest)]
    return convs.select("conv_id", "length"), parts[0].union(parts[1])


def plain(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: members and turns for ``trie``."""
    found = pin(found, "turns")
    convs = found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    return convs, found.join(convs, "conv_id").select("conv_id", (F.col("at") + 1).alias("depth"), "code", "chars", (F.col("at") + 1 == F.col("length")).alias("last"))


def _name(depth: Column, words: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws("-", depth, *words).cast("binary")))


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): sorted ids go into the hash one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            nodes, out = [], []
            for this, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if this != node:
                    if node is not None:
                        nodes.append(node)
                        out.append(digest.hexdigest())
                    node, digest = this, hashlib.sha256(str(conv_id).encode())
                else:
                    digest.update(b",%d" % conv_id)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    return ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


def trie(members: DataFrame, steps: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end.

    ``members``: (conv_id, length); ``steps``: their turns (conv_id, depth, code, chars, last).
    """
    zero = [F.lit(0).cast("long")] * 4
    root = _name(F.lit(0), zero)
    part = F.md5(F.concat_ws(":", "depth", "code").cast("binary"))
    words = [F.conv(F.substring(part, 8 * i + 1, 8), 16, 10).cast("long").alias(f"w{i + 1}") for i in range(4)]
    summed = running(steps.select("*", *words), ["conv_id"], ["depth"], {s: F.col(f"w{i + 1}") for i, s in enumerate(_WORDS)}, slices)
    node = _name(F.col("depth"), [F.col(s) for s in _WORDS])
    parent = _name(F.col("depth") - 1, [F.col(s) - F.col(f"w{i + 1}") for i, s in enumerate(_WORDS)])
    steps = pin(summed.select("conv_id", "depth", node.alias("node"), parent.alias("parent"), "code", "chars", "last"), "steps")

    nodes = steps.groupBy("node").agg(*[F.first(c).alias(c) for c in ("depth", "parent", "code", "chars")], F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    top = top.select(root.alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("string").alias("code"), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs")
    nodes = pin(nodes.union(top), "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = pin(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")

    # Paths: where a conversation takes one of several ways, the digest of the turn it takes.
    ways = nodes.filter("n_children > 1").select(F.col("node").alias("parent"))
    forks = steps.join(ways, "parent").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "code"))).alias("forks"))
    taken = F.filter(F.coalesce("forks", F.array().cast("array<struct<depth:bigint,code:string>>")), lambda f: f["depth"] <= F.col("depth"))
    named = nodes.join(forks, "conv_id", "left").withColumn("path", F.array_join(F.transform(taken, lambda f: f["code"]), "")).drop("forks", "code")
    named = pin(named, "paths")

    # In preorder, with a row behind each path: digits of a digest sort before 'g'.
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    items = named.select(F.col("path").alias("key"), "depth", "path", "node", F.lit(1).cast("long").alias("one"), leaf.alias("leaf"), saved.alias("saved"))
    none = F.lit(0).cast("long")
    ends = named.select("path").distinct().select(F.concat("path", F.lit("g")), F.lit(_LAST), "path", F.lit(None).cast("binary"), none, none, none)
    order = pin(running(items.union(ends), [], ["key", "depth"], {"pre": F.col("one"), "leaves": F.col("leaf"), "all_saved": F.col("saved")}, slices), "preorder")
    stops = order.filter("node is null").select("path", F.col("pre").alias("subtree_end"), F.col("leaves").alias("stop_leaves"), F.col("all_saved").alias("stop_saved"))
    subtrees = order.filter("node is not null").join(stops, "path").select(
        "node",
        (F.col("pre") - 1).alias("preorder"),
        (F.col("subtree_end") - 1).alias("subtree_end"),
        (F.col("stop_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("stop_saved") - F.col("all_saved") + F.col("saved")).alias("saved_tokens"),
    )
    ended = steps.filter("last").select("node", "conv_id").union(members.filter("length = 0").select(root.alias("node"), "conv_id"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(subtrees, "node").join(_digests(ended), "node", "left").join(above, "parent", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "preorder", "subtree_end")
