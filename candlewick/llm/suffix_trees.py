"""Operator 11: removal of repeated word windows by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document; it is a suffix of the
document's words cut at that length. Windows with the same words that start
earlier (smaller doc_id, or the same document and an earlier start) make a
later one a repeat, and every word that a repeat covers is removed.

Suffixes are split into groups so that equal ones fall together and each group
fits into memory, and each group's suffix tree is built by itself:

1. The short prefix. In each window the smallest of its runs of GRAM words (by
   a mixed hash, leftmost first) stands for it: neighbouring suffixes mostly
   share it, so they travel as one segment of words and not one by one. A gram
   that occurs once in the corpus has one leaf below it and is not looked at again.
2. The long prefix. A gram with more than LIMIT segments is split by all
   ``window`` words. Such a group is one node, of any number of leaves, so its
   earliest leaf is a minimum that Spark aggregates; nothing is gathered.
3. The trees. A group of at most LIMIT segments is built from the words
   themselves: suffixes are sorted, neighbours' common prefixes give the inner
   nodes, and those ``window`` words deep are the repeats. All their leaves but
   the earliest are removed.

Equal texts are one text to the trees. The text of the smallest doc_id is kept
to be looked at; every other copy is covered by earlier windows as a whole (or has
no window). Texts are laid out once, compressed, in a table bucketed by document,
so that the two later passes over them move positions and no texts.

Null and empty texts have no words; shorter texts than a window lose nothing.
A null doc_id comes after all others; documents that share an id come in order of
a hash; rows that repeat both id and text are one document and each
get its result. A very long text takes memory in proportion in its own task.
Other columns are ignored, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin, shared_path

WINDOW = 20
GRAM = 8
LIMIT = 4096
PIECE = 1 << 20
CHUNK = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


class Words:
    """The words of some texts: ``data`` has them with one space after each, ``start`` where each begins and ``first`` each text's first word."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        space = _SPACE[raw]
        ends = space.copy()
        ends[1:] &= ~space[:-1]
        ends[:1] = False
        keep = ~space | ends
        self.data = np.where(space, np.uint8(32), raw)[keep]
        begins = ~space
        begins[1:] &= space[:-1]
        self.first = np.searchsorted(np.flatnonzero(begins), np.cumsum([0, *(len(t) + 1 for t in texts)]))
        stops = np.flatnonzero(self.data == 32)
        self.start = np.concatenate([[0], stops + 1]).astype(np.int64)
        self.letters, lengths = self.data[self.data != 32], np.diff(self.start) - 1
        self.offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)

    def __len__(self) -> int:
        return len(self.start) - 1

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words, and the words by number."""
        words = pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.offsets), pa.py_buffer(np.ascontiguousarray(self.letters))])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary

    def hashes(self, *seeds: int) -> list[np.ndarray]:
        """A 64-bit hash of each word, for each seed."""
        ids, words = self.ids()
        listed = words.to_pylist()
        return [np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in listed), np.uint64, len(listed))[ids] for seed in seeds]

    def cut(self, a: int, b: int) -> bytes:
        """The words from a to b - 1, joined by one space."""
        return self.data[self.start[a] : max(self.start[a], self.start[b] - 1)].tobytes()


def pieces(packed: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of PIECE bytes or so together, unpacked, with the place of the first."""
    unpack, held, at, size = zstandard.ZstdDecompressor().decompress, [], 0, 0
    for i, z in enumerate(packed):
        held.append(unpack(z.as_buffer()))
        size += len(held[-1])
        if size >= PIECE or i + 1 == len(packed):
            yield at, held
            held, at, size = [], i + 1, 0


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A mixed hash of the ``size`` words at every place that has so many."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    part, have = hashes, 1
    for bit in bin(size)[3:]:
        part, have = part[:-have] * pow(int(_B), have, 1 << 64) + part[have:], 2 * have
        if bit == "1":
            part, have = part[:-1] * _B + hashes[have:][: len(part) - 1], have + 1
    part = (part ^ (part >> np.uint64(32))) * _C
    return part ^ (part >> np.uint64(29))


def runs(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, gram) of each run of windows of one text that share their smallest gram; starts count from the text's first word."""
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(hashes) - window + 1), 1 << 22):  # places fit into 24 bits
        h = hashes[at : at + (1 << 22) + window - 1]
        names = grams(h, gram)
        least = _sliding_min((names & ~_PLACE) | np.arange(len(names), dtype=np.uint64), window - gram + 1)
        starts = np.arange(at, at + len(least))
        text = np.searchsorted(first, starts, side="right") - 1
        whole = starts + window <= first[text + 1]
        starts, text, place = starts[whole], text[whole], (least[whole] & _PLACE).astype(np.int64)
        if len(starts):
            new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
            found.append((text[new], starts[new] - first[text[new]], np.diff(np.r_[new, len(starts)]), names[place[new]].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def bucketed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, tkey, z): each distinct text once, compressed, in a table bucketed by ``key``; and (doc_id, tkey) of all rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("tkey"), "text")
    firsts = keyed.groupBy("tkey").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("k"))
    firsts = pin(firsts.select(F.col("k.id").alias("id"), F.col("tkey").alias("digest")), "firsts")
    for seed in itertools.count():  # a 64-bit key for each document: the first seed that gives no two documents the same one
        if firsts.groupBy(F.xxhash64("id", "digest", F.lit(seed))).count().filter("count > 1").limit(1).count() == 0:
            break

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            z = pa.array([close(t.as_buffer()) for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], ["key", "doc_id", "tkey", "z"])

    packed = keyed.select(F.xxhash64("doc_id", "tkey", F.lit(seed)).alias("key"), "doc_id", "tkey", "text").mapInArrow(pack, "key long, doc_id long, tkey binary, z binary")
    # The digest is compared in a form that leaves ``key`` the only key of the join, so that the rows already lie by bucket.
    first = firsts.withColumn("key", F.xxhash64("id", "digest", F.lit(seed)))
    same = packed.join(first, "key").filter((F.col("tkey") >= F.col("digest")) & (F.col("tkey") <= F.col("digest")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"candlewick_texts_{uuid.uuid4().hex}"
    once = same.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("tkey").alias("tkey"), F.first("z").alias("z"))
    once.write.bucketBy(n, "key").option("path", shared_path(spark, "texts")).option("compression", "none").saveAsTable(name)
    return spark.table(name), keyed.select("doc_id", "tkey")


def _runs_of(texts: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for at, some in pieces(batch.column(1)):
                words = Words(some)
                text, start, n, name = runs(words.hashes(0)[0], words.first, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at + text]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(name)], ["key", "at", "n", "gram"])

    return texts.select("key", "z").mapInArrow(run, "key long, at int, n short, gram long")


def _segments(texts: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(gram, id, key, at, n, words) of the given runs, with all words of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            ends, inside = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), lists.flatten()
            at, n, name = (inside.field(i).to_numpy() for i in range(3))
            for begin, some in pieces(batch.column(2)):
                words = Words(some)
                of = np.repeat(np.arange(len(some)), np.diff(ends[begin : begin + len(some) + 1]))
                own = slice(ends[begin], ends[begin + len(some)])
                a = words.first[of] + at[own]
                b = a + n[own] + window - 1
                made = [name[own], docs[begin + of], keys[begin + of], at[own], n[own]]
                for i in range(0, len(a), CHUNK):
                    cut = [words.cut(x, y) for x, y in zip(a[i : i + CHUNK].tolist(), b[i : i + CHUNK].tolist())]
                    yield pa.RecordBatch.from_arrays([*[pa.array(x[i : i + CHUNK]) for x in made], pa.array(cut, pa.binary())], ["gram", "id", "key", "at", "n", "words"])

    by = found.groupBy("key").agg(F.collect_list(F.struct("at", "n", "gram")).alias("runs"))
    last = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id")
    return texts.select("key", last, "z").join(by, "key").mapInArrow(run, "gram long, id long, key long, at int, n short, words binary")


def subtrees(group: np.ndarray, doc: list[np.ndarray], at: np.ndarray, n: np.ndarray, words: list[bytes], window: int) -> np.ndarray:
    """For each segment a bit mask of its windows that are repeats: leaves of a deep inner node that are not its earliest.

    ``doc``: columns that order documents.

    All suffixes of all groups are sorted at once, by group first. The common prefix of neighbours gives
    the tree's inner nodes; a node ``window`` words deep is a stretch of suffixes with so many words in common.
    """
    tokens = Words(words)
    ids, _ = tokens.ids()
    segment = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    suffix = (tokens.first[segment] + step)[:, None] + np.arange(window)
    names = ids.astype(np.int64)[suffix]
    if window % 2:
        names = np.concatenate([names, np.zeros((len(names), 1), np.int64)], axis=1)
    packed = names[:, 0::2] << 32 | names[:, 1::2]
    order = np.lexsort([at[segment] + step, *(d[segment] for d in doc[::-1]), *packed.T[::-1], group[segment]])
    packed, in_group = packed[order], group[segment][order]
    common = packed[1:] == packed[:-1]  # pairs of words that neighbours share
    deep = common.all(axis=1) & (in_group[1:] == in_group[:-1])
    later = np.zeros(len(order), np.int64)
    later[order] = np.r_[False, deep]
    return np.bincount(segment, weights=later << step, minlength=len(n)).astype(np.int64)


def _from_trees(segments: DataFrame, window: int) -> DataFrame:
    """(key, start, stop) of the words that repeats in the segments cover; a task builds the trees of its groups one chunk of groups after another."""

    def build(table: pa.Table) -> pa.RecordBatch:
        group, doc, key, at, n = (table.column(i).to_numpy() for i in range(5))
        mask = subtrees(group, [doc, key], at.astype(np.int64), n.astype(np.int64), table.column(5).to_pylist(), window)
        hit = np.flatnonzero(mask)
        # A segment's windows start less than a window apart, so what its repeats cover is one span.
        low, high = (np.log2(m).astype(np.int32) for m in (mask[hit] & -mask[hit], mask[hit]))
        return _spans(key[hit], at[hit] + low, at[hit] + high + window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                rest.append(batch)
            if sum(b.num_rows for b in rest) >= CHUNK:
                table = pa.Table.from_batches(rest).combine_chunks()
                group = table.column(0).to_numpy()
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    yield build(table.slice(0, cut))
                rest = table.slice(cut).combine_chunks().to_batches()
        if rest:
            yield build(pa.Table.from_batches(rest).combine_chunks())

    return segments.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "key long, start int, stop int")


def _spans(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["key", "start", "stop"])


def _from_nodes(texts: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """The same of grams with more than LIMIT segments: each window is a group of its own, which has one node.

    Windows are named by two 64-bit hashes. A task settles the leaves that it has several of;
    one leaf a node and piece of texts goes on, to find the earliest of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            ends, inside = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), lists.flatten()
            at, n = inside.field(0).to_numpy(), inside.field(1).to_numpy().astype(np.int64)
            for begin, some in pieces(batch.column(2)):
                words = Words(some)
                name, other = (grams(h, window) for h in words.hashes(1, 2))
                own = slice(ends[begin], ends[begin + len(some)])
                text = np.repeat(np.repeat(np.arange(len(some)), np.diff(ends[begin : begin + len(some) + 1])), n[own])
                start = np.repeat(at[own], n[own]) + np.arange(len(text)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
                place = words.first[text] + start
                name, other, doc, key = name[place], other[place], docs[begin + text], keys[begin + text]
                order = np.lexsort([start, key, doc, other, name])
                new = np.r_[True, (name[order][1:] != name[order][:-1]) | (other[order][1:] != other[order][:-1])][: len(order)]
                first, later = order[new], np.sort(place[order[~new]])
                # What the settled leaves cover, as spans of words that do not touch within their text.
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, later, 1)
                np.add.at(change, later + window, -1)
                covered = np.cumsum(change)[:-1] > 0
                edge = np.zeros(len(words) + 1, bool)
                edge[words.first] = True
                opens = np.flatnonzero(covered & np.r_[True, ~covered[:-1] | edge[1:-1]][: len(covered)])
                shuts = np.flatnonzero(covered & np.r_[~covered[1:] | edge[1:-1], True][: len(covered)]) + 1
                of = np.searchsorted(words.first, opens, side="right") - 1
                none = np.zeros(len(opens), np.int64)
                yield _leaves(name[first].view(np.int64), other[first].view(np.int64), doc[first], key[first], start[first], start[first])
                yield _leaves(none, none, none, keys[begin + of], opens - words.first[of], shuts - words.first[of])

    by = found.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    last = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id")
    leaves = texts.select("key", last, "z").join(by, "key").mapInArrow(run, "name long, other long, id long, key long, start int, stop int")
    leaves = pin(leaves, "leaves")
    across = leaves.filter("start = stop")
    nodes = across.groupBy("name", "other").agg(F.min(F.struct("id", "key", "start")).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", "other", "earliest")
    more = across.join(pin(nodes, "nodes"), ["name", "other"]).filter(F.struct("id", "key", "start") != F.col("earliest"))
    return leaves.filter("start < stop").select("key", "start", "stop").union(more.select("key", "start", (F.col("start") + window).alias("stop")))


def _leaves(name: np.ndarray, other: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Leaves with start = stop, or spans of words without a name."""
    return pa.RecordBatch.from_arrays([*map(pa.array, (name, other, doc, key)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["name", "other", "id", "key", "start", "stop"])


def repeats(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """(key, start, stop): spans of words that repeats cover; spans may overlap."""
    every = pin(_runs_of(texts, window, gram), "all-runs")
    shared = pin(every.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared")  # written, so that the join below can split a frequent gram
    found = pin(every.join(shared, "gram").select("gram", "key", "at", "n", (F.col("size") > limit).alias("large")), "runs")
    return _from_trees(_segments(texts, found.filter("not large"), window), window).union(_from_nodes(texts, found.filter("large"), window))


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (removed words as [start, end) pairs), kept (the words left, joined by a space), kept_sha256."""
    if not 0 < gram <= window <= gram + 50:
        raise ValueError("gram is 1 to window words, and at most 50 words less")
    texts, rows = bucketed(docs)
    masks = pin(repeats(texts, window, gram, limit), "repeats").groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, some in pieces(batch.column(2)):
                words, n_words, n_removed, spans, kept, digests = Words(some), [], [], [], [], []
                for k in range(len(some)):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    change = np.zeros(b - a + 1, np.int64)
                    for hit in batch.column(3)[begin + k].as_py() or ():
                        change[hit["start"]] += 1
                        change[hit["stop"]] -= 1
                    gone = np.cumsum(change)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    left = words.data[words.start[a] : words.start[b]][np.repeat(~gone, np.diff(words.start[a : b + 1]))].tobytes()[:-1]
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    spans.append(edges.reshape(-1, 2).tolist())
                    kept.append(left.decode())
                    digests.append(hashlib.sha256(left).hexdigest())
                made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(some)).columns[:2], *made], ["least", "tkey", "n_words", "n_removed", "spans", "kept", "kept_sha256"])

    done = texts.join(masks, "key", "left").select("doc_id", "tkey", "z", "hits").mapInArrow(run, "least long, tkey binary, n_words long, n_removed long, spans array<array<long>>, kept string, kept_sha256 string")
    copy = ~F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("n_words") >= window)
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    return rows.join(done, "tkey").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(copy, "").otherwise(F.col("kept")).alias("kept"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
