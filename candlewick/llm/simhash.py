"""Operator 2: near-duplicates by SimHash, compared exactly in tiles.

A text is lower-cased (A-Z only), cut at white space into words and taken as
its shingles of ``shingle`` words, repeats included. A fingerprint has 64 bits;
a bit is set where more than half of the shingles' XXH64 (seed 42) have it.
Fingerprints link if at most ``radius`` bits differ, and linked ones form a
component named by its smallest doc_id.

Equal fingerprints are one row before anything is compared. Two fingerprints
within the radius agree in at least one of ``radius + 1`` bands of bits, so
rows are laid out by (band, value); that keeps the comparison exact and each
layout cell a small fraction of the rows. Cells are sorted by bit count and cut
into tiles; a pair of tiles is one unit of work, compared by exclusive or and
bit counts in numpy, and pairs whose bit counts lie further apart than the
radius are never made. A unit returns a spanning forest of the links it has
found, not the links: components stay the same and a cell of mutual copies
gives as many rows as it has members. A cell of any size becomes many units.

Components come from alternating star contraction on the forest, one pinned
table a round, with no driver state but a row count.

Null and empty texts have fingerprint zero and link like any other; texts with
fewer words than a shingle are one shingle; repeated rows share a component;
rows with a null doc_id take part, but null names no component unless all
members are null. A very long text is hashed whole, in its own task's memory.
Other columns are ignored, whatever they are called (kept by ``keep_one`` and
``keep_one_copy``); an empty table gives no rows.

``near_copies`` is for cleaning a corpus: texts link if the Jaccard similarity
of their sets of shingles (five words, as XXH64 values) is 0.8 or more. Its cells are, first, the
components of the fingerprints as above (``fingerprint_cells``). At that
similarity fingerprints are expected to differ by about 10 of 64 bits, many pairs
by more; at such a radius the bands of bits hardly part the rows and nearly every
pair would be compared. So for what lies beyond the radius there are MinHash bands as
further cells. Each pair is confirmed on the sets themselves: first each member of a cell
against one of them, then, where a cell still holds several components, tile against tile. Texts
with one set are one row; texts without words link with one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, pin, text_key, tidy

RADIUS = 2
SHINGLE = 3
SEED = 42
TILE = 2048
# Near copies: shared part of all distinct five-word shingles, and MinHash bands that meet at 0.8 with probability 1 - (1 - 0.8 ** 4) ** 20 = 0.99997.
SIMILARITY = 0.8
COPY_SHINGLE = 5
BANDS, ROWS = 20, 4
# Shingles of all texts of a tile together, so that long texts make tiles of few.
TILE_SHINGLES = 1 << 20
COPY_TILE = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
    n = max(1, len(gaps) + 2 - shingle)
    starts = [0, *(g + 1 for g in gaps)][:n]
    ends = [*gaps, len(data)][len(gaps) + 1 - n :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(data[a:b], SEED) for a, b in zip(starts, ends)], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tkey, fp) with the text's digest, and the fingerprint as a signed long."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "tkey", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, tkey string, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between the rows of two tiles (or of one with itself)."""
    values, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(values))
    froms, tos = [], []
    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        froms.append(x[i + at])
        tos.append(y[j])
    u, v = np.concatenate(froms), np.concatenate(tos)
    apart = u != v
    u, v = u[apart], v[apart]
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(len(values)))
    return values[child], values[label[child]]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v) pairs of distinct fingerprints that span every component of the links within the radius."""
    bands = radius + 1
    cuts = [64 * i // bands for i in range(bands + 1)]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft("fp", 64 - cuts[i + 1]), 64 - cuts[i + 1] + cuts[i]).alias("value")) for i in range(bands)])
    rows = fps.select("fp", F.bit_count("fp").alias("ones"), F.explode(keys).alias("k")).select("fp", "ones", "k.band", "k.value")
    # Each (band, value, ones) is cut into tiles by hash; the tile counts are a small table of cells with two rows or more.
    counts = rows.groupBy("band", "value", "ones").count()
    whole = Window.partitionBy("band", "value")
    cells = counts.withColumn("cell", F.sum("count").over(whole)).filter("cell > 1")
    small = cells.filter(F.col("cell") <= tile).select("band", "value", "ones", F.lit(1).alias("tiles"), F.lit(False).alias("big"), F.array().cast("array<struct<ones:int,tiles:int>>").alias("peers"))
    big = cells.filter(F.col("cell") > tile).withColumn("tiles", F.ceil(F.col("count") / tile).cast("int"))
    # At most 65 bit counts a cell, so the list of peers is short.
    span = whole.orderBy("ones").rangeBetween(0, radius)
    big = big.select("band", "value", "ones", "tiles", F.lit(True).alias("big"), F.collect_list(F.struct("ones", "tiles")).over(span).alias("up"), F.collect_list(F.struct("ones", "tiles")).over(whole.orderBy("ones").rangeBetween(-radius, -1)).alias("down"))
    layout = small.withColumn("up", F.col("peers")).withColumn("down", F.col("peers")).drop("peers").unionByName(big)
    rows = rows.join(layout, ["band", "value", "ones"]).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # A unit is an ordered pair of tiles (ones, t) <= (ones, t); a row goes to the units that its tile belongs to.
    mine = lambda o, t: F.struct((o.cast("int") + 1).alias("ones"), t.cast("int").alias("t"))
    tiles_of = lambda side: F.flatten(F.transform(side, lambda p: F.transform(F.sequence(F.lit(0), p["tiles"] - 1), lambda t: mine(p["ones"], t))))
    me = mine(F.col("ones"), F.col("t"))
    ups = F.transform(F.filter(tiles_of(F.col("up")), lambda p: p >= me), lambda p: F.struct(me.alias("a"), p.alias("b")))
    same = F.transform(F.filter(tiles_of(F.col("up")), lambda p: (p["ones"] == me["ones"]) & (p < me)), lambda p: F.struct(p.alias("a"), me.alias("b")))
    downs = F.transform(tiles_of(F.col("down")), lambda p: F.struct(p.alias("a"), me.alias("b")))
    zero = mine(F.lit(-1), F.lit(0))  # no bit count is stored as 0
    units = F.when(F.col("big"), F.concat(ups, same, downs)).otherwise(F.array(F.struct(zero.alias("a"), zero.alias("b"))))
    work = rows.select("band", "value", "fp", "big", me.alias("me"), F.explode(units).alias("u")).select("band", "value", "u", "fp", (F.col("big") & (F.col("me") != F.col("u.a"))).alias("right"))

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.ascontiguousarray(pdf.fp.to_numpy()).view(np.uint64)
        right = pdf.right.to_numpy(bool)
        left = fp[~right]
        u, v = forest(left, fp[right] if right.any() else left, radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of one tile, run by run of a sorted partition instead of one call for each."""
        rest = np.zeros((0, 3), np.int64)
        for batch in batches:
            now = np.concatenate([rest, np.stack([x.to_numpy().astype(np.int64) for x in batch.columns], axis=1)])
            cut = np.flatnonzero((now[1:, :2] != now[:-1, :2]).any(axis=1))
            last = cut[-1] + 1 if len(cut) else 0
            rest, done = now[last:], now[:last]
            yield _runs(done, radius)
        yield _runs(rest, radius)

    one_tile = F.expr("not (right or u.a.ones > 0 or u.b.ones > 0)")
    tiny = work.filter(one_tile).select("band", "value", "fp").repartition("band", "value").sortWithinPartitions("band", "value")
    pairs = work.filter(~one_tile).groupBy("band", "value", "u").applyInPandas(unit, "u long, v long")
    return tiny.mapInArrow(runs, "u long, v long").union(pairs)


def _runs(rows: np.ndarray, radius: int) -> pa.RecordBatch:
    u, v = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    if len(rows):
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        fp = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        # Short runs: row against the row d places later, for all runs at once.
        for d in range(1, min(int(sizes.max()), 64)):
            ok = np.repeat(sizes <= 64, sizes)[:-d] & (np.repeat(starts, sizes)[:-d] == np.repeat(starts, sizes)[d:])
            i = np.flatnonzero(ok & (np.bitwise_count(fp[:-d] ^ fp[d:]) <= radius))
            u.append(fp[i])
            v.append(fp[i + d])
        for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
            a, b = forest(fp[s : s + n], fp[s : s + n], radius)
            u.append(a)
            v.append(b)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: alternating large-star and small-star rounds until no edge moves."""
    now = pin(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        both = now.select("u", "v").union(now.select("v", "u"))
        low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("c")).alias("moved"))
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        edge = lambda u, moved: F.struct(F.col(u).alias("u"), F.col("m").alias("v"), moved.alias("moved"))
        both = F.array(edge("v", F.col("moved") | (F.col("v") != F.col("m"))), edge("u", F.col("moved")))
        small = large.join(low, F.col("u") == F.col("c")).select(F.explode(both).alias("e")).select("e.*")
        # An edge that a star has moved is marked, so a round needs no comparison with the one before.
        now = pin(small.filter("u != v").groupBy("u", "v").agg(F.max("moved").alias("moved")), "edges")
        if not now.filter("moved").limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, tkey (the text's digest), fp (signed long), root (the component's own fingerprint), component_id."""
    rows = pin(fingerprints(docs, shingle), "fingerprints")
    nodes = pin(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(nodes.select("fp"), radius, tile))
    grouped = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "tkey", "fp", "root", "component_id")


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles of a text as sorted XXH64 values; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) + 1 - shingle))} if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """MinHash keys, one for each of ``BANDS`` bands of ``ROWS`` minima; equal in a band with probability similarity ** ROWS."""
    r = np.random.default_rng(SEED)
    mask, factor = r.integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        mixed = (hashes[None, at : at + 512] ^ mask) * (factor | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        low = np.minimum(low, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64).view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, tkey, node, size, keys, fp): the digest of the text's set of shingles, its size and its MinHash keys (none for an empty set), and its fingerprint."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), shingle) for x in batch.column(2)]
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(2)], np.uint64).view(np.int64)
            nodes = pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets], pa.string())
            keys = pa.array([bands(x) if len(x) else [] for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], nodes, pa.array([len(x) for x in sets], pa.int64()), keys, pa.array(fps)], ["doc_id", "tkey", "node", "size", "keys", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, tkey string, node string, size long, keys array<long>, fp long")


def fingerprint_cells(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, size, band, key): the component of fingerprints within the radius that each set of shingles lies in; ``rows`` (node, size, fp)."""
    rows = rows.filter("size > 0").select("node", "size", "fp").distinct()
    roots = components(links(rows.select("fp").distinct(), radius))
    found = rows.join(roots, rows.fp == roots.node, "left").select(rows.node, "size", F.lit(BANDS).alias("band"), F.coalesce("root", "fp").alias("key"))
    return found.distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have the Jaccard similarity or more."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    of = lambda side, name: sets.select(F.col("node").alias(side), F.col("hashes").alias(name))
    return pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(run, "u string, v string")


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (u, v) between n things: at most n - 1 links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            child = np.flatnonzero(label != np.arange(n))
            return child, label[child]


def shared_counts(owner: np.ndarray, hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each of the ``left`` sets shares with each of the ``right`` ones; ``owner`` is the set of each hash."""
    _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
    kept = times[column] > 1  # what one set has alone is shared with none
    _, column = np.unique(column[kept], return_inverse=True)
    owner, n = owner[kept], int(max(left.max(), right.max())) + 1
    counts = np.zeros((len(left), len(right)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        own = slice(*np.searchsorted(column, [at, at + 2048]))
        has = np.zeros((n, 2048), np.float32)
        has[owner[own], column[own] - at] = 1
        counts += has[left] @ has[right].T
    return counts


def cell_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that join components within cells: ``members`` (band, key, tiles, node, size, root) in tiles, every pair of two roots compared exactly.

    A unit is a cell and a pair of its tiles, worked out from a sorted stream; it returns a spanning forest of its links, never all of them.
    """
    t, last = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"), F.col("tiles") - 1
    unit = lambda a, b, right: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(right).alias("right"))
    units = F.concat(F.transform(F.sequence(t, last), lambda b: unit(t, b, False)), F.transform(F.filter(F.sequence(F.lit(0), t), lambda a: a < t), lambda a: unit(a, t, True)))
    rows = members.select("band", "key", "node", "root", F.explode(units).alias("x")).select("band", "key", "x.a", "x.b", "x.right", "node", "root")
    keys = ["band", "key", "a", "b"]

    def links(node: list[str], root: np.ndarray, right: np.ndarray, lists: list[np.ndarray]) -> tuple[list[str], list[str]]:
        sizes = np.array([len(x) for x in lists])
        one = not right.any()
        left, other = np.flatnonzero(~right), np.arange(len(node)) if one else np.flatnonzero(right)
        if not len(left) or not len(other):
            return [], []
        both = shared_counts(np.repeat(np.arange(len(node)), sizes), np.concatenate(lists), left, other)
        near = (both >= similarity * (sizes[left][:, None] + sizes[other][None, :] - both)) & (root[left][:, None] != root[other][None, :])
        i, j = np.nonzero(near)
        child, parent = spanning(left[i], other[j], len(node))
        return [node[k] for k in child], [node[k] for k in parent]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> pa.RecordBatch:
            nodes, roots, sides, lists = zip(*held)
            codes = {r: k for k, r in enumerate(dict.fromkeys(roots))}
            u, v = links(list(nodes), np.array([codes[r] for r in roots]), np.array(sides, bool), list(lists))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], ["u", "v"])

        for batch in batches:
            units = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            rows = zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), batch.column(4).to_pylist())
            for k, (this, row) in enumerate(zip(units, rows)):
                if this != current:
                    if held:
                        yield done()
                    current, held = this, []
                held.append((*row, batch.column(7)[k].values.to_numpy()))
        if held:
            yield done()

    dealt = rows.join(sets, "node").select(*keys, "right", "node", "root", "hashes").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u string, v string")


@contextmanager
def small_batches(spark: SparkSession):
    """Fewer rows in an Arrow batch for what is written inside: rows here carry whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 500)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = COPY_SHINGLE, tile: int = COPY_TILE) -> DataFrame:
    """One row per document: doc_id, tkey, root (of the component), component_id; texts link at the Jaccard similarity of their sets of shingles."""
    with small_batches(docs.sparkSession):
        rows = pin(sketches(docs, shingle), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("tkey").alias("tkey"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = pin(nodes, "distinct")
    keyed = pin(fingerprint_cells(rows), "fingerprints").union(nodes.select("node", "size", F.posexplode("keys").alias("band", "key")))
    cells = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"), F.min_by("size", "node").alias("hub_size")).filter("n > 1")
    cells = pin(keyed.join(cells, ["band", "key"]), "cells")
    # Only texts that share a cell are read again.
    wanted = nodes.join(cells.select("node").distinct(), "node", "left_semi").select("tkey", "node")
    texts = docs.select(text_key().alias("tkey"), F.col("text").cast("string").alias("text")).join(wanted, "tkey").dropDuplicates(["node"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    with small_batches(docs.sparkSession):
        sets = pin(texts.select("node", "text").mapInArrow(run, "node string, hashes array<long>"), "sets")
    alike = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)
    # First each cell's members against one of them: a large group of copies is joined by as many pairs as it has members.
    pairs = cells.filter((F.col("node") != F.col("hub")) & alike(F.col("size"), F.col("hub_size"))).select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    with small_batches(docs.sparkSession):
        edges = pin(confirmed(pairs, sets, similarity), "edges")
    roots = components(edges)
    # Then, in cells that still hold several components, all pairs between these, in tiles of a bounded number of texts and shingles.
    left = cells.join(roots, "node", "left").select("node", "size", "band", "key", F.coalesce("root", "node").alias("root"))
    mixed = left.groupBy("band", "key").agg((F.min("root") != F.max("root")).alias("mixed"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    mixed = mixed.filter("mixed").select("band", "key", F.ceil(F.greatest(F.col("n") / tile, F.col("all") / TILE_SHINGLES)).cast("int").alias("tiles"))
    left = pin(left.join(mixed, ["band", "key"]), "mixed")
    with small_batches(docs.sparkSession):
        more = pin(cell_links(left, sets, similarity), "edges")
    if more.limit(1).count():
        roots = components(edges.union(more))
    grouped = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    named = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return rows.join(named, "node").select("doc_id", "tkey", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component of ``near_duplicates``."""
    return _first(docs, near_duplicates(docs, radius, shingle))


def keep_one_copy(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = COPY_SHINGLE) -> DataFrame:
    """``docs`` with one document of each component of ``near_copies``."""
    return _first(docs, near_copies(docs, similarity, shingle))


def _first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each component the document with the smallest doc_id, by text digest among equal ids, once if its row is repeated."""
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min_by(F.struct("doc_id", "tkey"), "tkey").alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.tkey").alias("kept_text"))
    rows = boxed(docs, id=F.col("doc_id"), text=text_key())
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text") == F.col("kept_text")), "left_semi")
    return out.dropDuplicates(["id", "text"]).select("row.*")
