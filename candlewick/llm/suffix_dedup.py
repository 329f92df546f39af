"""Operator 6: removal of long repeated byte strings by distributed prefix doubling.

Two positions start the same string of ``length`` bytes if they have the same
rank; the rank of 2h bytes is the pair of the ranks of h bytes at a position
and h further on. Ranks are 64-bit names made by nesting that pairing, so equal
strings have equal names wherever they lie, and Spark sorts (name, position)
rows to find what is repeated at h before 2h is looked at. What is unique
drops out.

Most positions never enter a sort. In every string of ``length`` bytes the
smallest name of its quarter-length substrings (the leftmost of them) is its
anchor, found for all positions at once. Copies of a string have their anchor
at the same place, so a position can only be repeated if its anchor is:

1. names of length/4 at the anchors (two in ``length`` positions or so),
2. names of length/2 from the anchor on, and around it, of those repeated,
3. all bytes that the strings with one anchor can cover; where these recur as a
   whole, every one of the strings does, and one place stands for all,
4. the same for blocks of BLOCK neighbouring positions: unless the bytes that all
   strings of a block share recur, none of them does; if the bytes that any of
   them covers recur, all do; what is between goes on,
5. pairs of names of length/2, that is ranks of the full length, of every
   position that is left, packed into rows by bucket of the name.

In each round a task first resolves what is repeated inside it and sends on
one row for each name, so a string in a third of all texts is a row for each
task, not a hot key. Equal texts are told apart once and count as one text; a
text of enough bytes with a copy is removed as a whole.

A byte is removed if a repeated string covers it; overlapping repeats within a
text count. Null and empty texts have no bytes; texts shorter than ``length``
lose nothing unless a copy of full length exists, which cannot be; repeated
rows are copies of one another; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin

LENGTH = 400
PIECE = 1 << 20
FLUSH = 400_000
BUCKET = 1_000_000
BLOCK = 50

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * _A + (y ^ (y >> np.uint64(29))) * _B
    z ^= z >> np.uint64(32)
    z *= _C
    return z ^ (z >> np.uint64(31))


def names(data: np.ndarray, size: int) -> np.ndarray:
    """The name of the ``size`` bytes at every position that has so many."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    part, have = _BYTE[data], 1
    for bit in bin(size)[3:]:
        part, have = _pair(part[:-have], part[have:]), 2 * have
        if bit == "1":
            part, have = _pair(part[:-1], _BYTE[data[have:]][: len(part) - 1]), have + 1
    return part


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Pieces:
    """Texts laid end to end up to PIECE bytes; longer ones are cut with an overlap of length - 1 bytes."""

    def __init__(self, texts: Iterator[tuple[bytes, bytes]], length: int):
        self.texts, self.length = texts, length

    def __iter__(self):
        buffer, index, size = [], [], 0
        for key, data in self.texts:
            at = 0
            while at + self.length <= len(data):
                part = data[at : at + PIECE + self.length - 1]
                index.append((key, at, size, len(part), data))
                buffer.append(part)
                size += len(part)
                at += PIECE
                if size >= PIECE:
                    yield np.frombuffer(b"".join(buffer), np.uint8), index
                    buffer, index, size = [], [], 0
        if index:
            yield np.frombuffer(b"".join(buffer), np.uint8), index


def anchors(data: np.ndarray, index: list, length: int):
    """For a piece: (text number in the index, position in the buffer) of the anchors of its strings."""
    quarter = length // 4
    gram = names(data, quarter)
    packed = (gram & ~np.uint64((1 << 24) - 1)) | np.arange(len(gram), dtype=np.uint64)
    least = _sliding_min(packed, length - quarter + 1)
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    begin = np.array([i[2] for i in index])
    valid = np.zeros(len(least), bool)
    for _, _, at, n, _ in index:
        valid[at : at + n - length + 1] = True
    place = np.unique(place[valid])
    return np.searchsorted(begin, place, side="right") - 1, place, gram


def _text_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    seen = set()
    for batch in batches:
        for text in batch.column("text"):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            key = hashlib.md5(data).digest()
            if key not in seen:
                seen.add(key)
                yield key, data


def _split(name: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For rows in one task: which are repeated here, and which stand for their name outside.

    ``name`` and ``place`` are the columns of a row's name and position; rows of one place are one position.
    """
    order = np.lexsort([*place, *name])
    n = len(order)
    sure, first = np.zeros(n, bool), np.zeros(n, bool)
    if n == 0:
        return sure, first
    new_name = np.zeros(n, bool)
    new_name[0] = True
    for x in name:
        y = x[order]
        new_name[1:] |= y[1:] != y[:-1]
    new_place = new_name.copy()
    for x in place:
        y = x[order]
        new_place[1:] |= y[1:] != y[:-1]
    group = np.cumsum(new_name) - 1
    kinds = np.bincount(group, weights=new_place)
    sure[order] = kinds[group] > 1
    first[order] = new_name
    return sure, first


def _numbers(keys: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(k, len(seen)) for k in keys], np.int64)


MARKS = "name long, tkey binary, at long, right long, left long, around long, more long, side int, sure boolean, sent boolean"
MARK_NAMES = [x.split()[0] for x in MARKS.split(", ")]


def _marks(name, tkeys, at, right, left, around, more, side) -> pa.RecordBatch:
    sure, first = _split([name], [at, _numbers(tkeys)])
    longs = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (right, left, around, more)]
    columns = [pa.array(name.view(np.int64)), pa.array(tkeys, pa.binary()), pa.array(at), *longs, pa.array(side.astype(np.int32)), pa.array(sure), pa.array(first)]
    return pa.RecordBatch.from_arrays(columns, MARK_NAMES)


def _find_anchors(docs: DataFrame, length: int) -> DataFrame:
    quarter, half = length // 4, length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(7)]
        count = 0

        def flush():
            batch = _marks(*[np.concatenate(x) if i != 1 else sum(x, []) for i, x in enumerate(out)], np.zeros(count, np.int64))
            for x in out:
                x.clear()
            return batch

        for data, index in Pieces(_text_bytes(batches), length):
            which, place, gram = anchors(data, index, length)
            wide = _pair(gram[:-quarter], gram[quarter:])
            keys = [index[i][0] for i in which]
            shift = np.array([i[1] - i[2] for i in index])[which]
            ends = np.array([i[2] + i[3] for i in index])[which]
            begins = np.array([i[2] for i in index])[which]
            at = place + shift
            # Names that would leave the piece are 0: no string of this piece needs them. An anchor that two
            # overlapping pieces share is a row of each, for one place.
            right = np.where(place + half <= ends, wide[np.minimum(place, len(wide) - 1)], np.uint64(0))
            left = np.where(place - quarter >= begins, wide[np.maximum(place - quarter, 0)], np.uint64(0))
            reach = length - quarter
            whole = [xxhash.xxh3_128_intdigest(index[i][4][max(0, p - reach) : p + length], min(p, reach)) for i, p in zip(which.tolist(), at.tolist())]
            around = np.array([w & (2**64 - 1) for w in whole], np.uint64)
            more = np.array([w >> 64 for w in whole], np.uint64)
            for x, y in zip(out, (gram[place], keys, at, right, left, around, more)):
                x.append(y)
            count += len(keys)
            if count >= FLUSH:
                yield flush()
                count = 0
        if count:
            yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, MARKS)


def _repeated(marks: DataFrame) -> DataFrame:
    """The rows whose name occurs at another position too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            name = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(name[1:] != name[:-1])[-1]) + 1 if len(name) and name[0] != name[-1] else 0
            rest, done = batch.slice(cut), batch.slice(0, cut)
            if len(done):
                yield check(done)
        if rest is not None and len(rest):
            yield check(rest)

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        sure, _ = _split([batch.column(0).to_numpy()], [batch.column(2).to_numpy(), _numbers(batch.column(1).to_pylist())])
        return batch.filter(pa.array(sure & ~batch.column(8).to_numpy(zero_copy_only=False)))

    found = marks.filter("sent").repartition("name").sortWithinPartitions("name").mapInArrow(run, MARKS)
    return marks.filter("sure").union(found)


def _halves(left: DataFrame) -> DataFrame:
    """Round 2 rows: the names of half the length, from the anchor on and around it."""
    zero = np.uint64(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            at, right, around = (batch.column(i).to_numpy() for i in (2, 3, 4))
            right, around = (np.ascontiguousarray(x).view(np.uint64) for x in (right, around))
            c1, c2 = (batch.column(i).to_numpy() for i in (5, 6))
            r, a = np.flatnonzero(right != zero), np.flatnonzero(around != zero)
            name = np.concatenate([right[r], around[a]])
            rows = np.concatenate([r, a])
            side = np.r_[np.zeros(len(r), np.int64), np.ones(len(a), np.int64)]
            # A name of the other side is another place of the text: shift it, so that one place has one name.
            place = at[rows] - side
            nothing = np.zeros(len(rows), np.uint64)
            yield _marks(name, [keys[i] for i in rows], place * 2 + side, nothing, nothing, c1[rows], c2[rows], side)

    return left.mapInArrow(run, MARKS)


WHOLE = "tkey binary, anchor long, sides int, around long, more long, sent boolean, state int"


def _wholes(anchors_left: DataFrame) -> DataFrame:
    """Anchors with a state: 0 alone, 1 standing for a surrounding that recurs, 2 another place of such a surrounding."""

    def states(batch_columns, last: bool):
        keys, at, around, more = batch_columns
        sure, first = _split([around, more], [at, _numbers(keys)])
        return sure, first

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, around, more = batch.column(0).to_pylist(), *(batch.column(i).to_numpy() for i in (1, 3, 4))
            sure, first = states((keys, at, around, more), False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first | ~sure), pa.array(np.where(sure, np.where(first, 1, 2), 0).astype(np.int32))], WHOLE_NAMES)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            name = batch.column(3).to_numpy()
            cut = int(np.flatnonzero(name[1:] != name[:-1])[-1]) + 1 if len(name) and name[0] != name[-1] else 0
            rest, done = batch.slice(cut), batch.slice(0, cut)
            if len(done):
                yield final(done)
        if rest is not None and len(rest):
            yield final(rest)

    def final(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, at, around, more = batch.column(0).to_pylist(), *(batch.column(i).to_numpy() for i in (1, 3, 4))
        sure, first = states((keys, at, around, more), True)
        known = batch.column(6).to_numpy() > 0
        state = np.where(first & (sure | known), 1, np.where(sure | known, 2, 0)).astype(np.int32)
        return batch.set_column(6, "state", pa.array(state))

    marked = pin(anchors_left.mapInArrow(local, WHOLE), "wholes")
    met = marked.filter("sent").repartition("around").sortWithinPartitions("around").mapInArrow(meet, WHOLE)
    return marked.filter("not sent").union(met)


WHOLE_NAMES = [x.split()[0] for x in WHOLE.split(", ")]


def _starts(n: int, spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Union of the spans of starts, within a text of n bytes."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, a), min(n - length, b)) for a, b in spans):
        if b < a:
            continue
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(texts: DataFrame, length: int) -> DataFrame:
    """Round 4 rows: for each block of candidate positions the name of what its strings share, and of all they cover."""
    reach = length - length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, keys, at, first_in, around, more, width = [], [], [], [], [], [], []
            for key, text, places in zip(*(batch.column(i) for i in range(3))):
                data, key = text.as_py().encode("utf-8", "surrogatepass"), key.as_py()
                n, done = len(data), set()
                for place in places.as_py():
                    if place["state"] == 2:
                        continue
                    for last in range(place["anchor"], place["anchor"] - reach - 1, -BLOCK):
                        first = last - BLOCK + 1
                        p, q = max(0, first), min(last, n - length)
                        side = 1 if place["anchor"] - last < reach // 2 else 2
                        if q < p or not place["sides"] & side or first in done:
                            continue
                        done.add(first)
                        whole = xxhash.xxh3_128_intdigest(data[p : q + length], (p - first) * length + last - q)
                        name.append(xxhash.xxh3_64_intdigest(data[last : first + length]))
                        keys.append(key)
                        at.append(last)  # where the shared bytes stand; the block itself begins at p
                        first_in.append(p)
                        around.append(whole & (2**64 - 1))
                        more.append(whole >> 64)
                        width.append(q - p)
            nothing = np.zeros(len(keys), np.uint64)
            yield _marks(np.array(name, np.uint64), keys, np.array(at, np.int64), np.array(first_in, np.uint64), nothing, np.array(around, np.uint64), np.array(more, np.uint64), np.array(width, np.int64))

    return texts.select("tkey", "text", "places").mapInArrow(run, MARKS)


PACKS = "bucket long, keys array<binary>, counts array<int>, pack binary"
PACK_KINDS = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
KIND = np.dtype([("hi", "<u8"), ("lo", "<u4"), ("at", "<u4")])


def _runs(at: np.ndarray) -> bytes:
    """Sorted positions as runs: first and last, 64 bits each."""
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    return np.stack([at[edge], at[np.r_[edge[1:] - 1, len(at) - 1]]], axis=1).astype("<i8").tobytes()


def _groups(rows: np.ndarray, *by: np.ndarray) -> Iterator[np.ndarray]:
    """The row numbers cut where a column of the sorted rows changes."""
    if len(rows):
        new = np.zeros(len(rows), bool)
        for x in by:
            new[1:] |= x[rows][1:] != x[rows][:-1]
        yield from np.split(rows, np.flatnonzero(new))


def _full_names(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Round 5 rows: the packed names and positions of candidates by bucket, text after text; a negative bucket holds a text's runs already known."""
    half, reach = length // 2, length - length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo, at, which, keys, rows = [], [], [], [], [], []
        count = 0

        def flush() -> pa.RecordBatch:
            if hi:
                h, low, a, t = (np.concatenate(x) for x in (hi, lo, at, which))
                sure, first = _split([h, low], [a, t])
                bucket = ((h >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)
                pick = np.flatnonzero(first | ~sure)
                for own in _groups(pick[np.lexsort([t[pick], bucket[pick]])], bucket):
                    pack = np.empty(len(own), KIND)
                    pack["hi"], pack["lo"], pack["at"] = h[own], low[own], a[own]
                    texts_in, counts = np.unique(t[own], return_counts=True)
                    rows.append((int(bucket[own[0]]), [keys[i] for i in texts_in], counts.astype(np.int32), pack.tobytes()))
                known = np.flatnonzero(sure)
                for own in _groups(known[np.argsort(t[known], kind="stable")], t):
                    runs(keys[t[own[0]]], _runs(np.sort(a[own])))
            out = pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), PACK_KINDS)], ["bucket", "keys", "counts", "pack"])
            for x in (hi, lo, at, which, keys, rows):
                x.clear()
            return out

        def runs(key: bytes, blob: bytes) -> None:
            rows.append((-1 - key[0], [key], [len(blob) // KIND.itemsize], blob))

        for batch in batches:
            for key, text, places, blocks in zip(*(batch.column(i) for i in range(4))):
                data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                key, blocks = key.as_py(), blocks.as_py() or []
                known = [(x["anchor"] - reach, x["anchor"]) for x in places.as_py() if x["state"]]
                known += [(x["anchor"], x["anchor"] + x["sides"]) for x in blocks if x["state"]]
                spans = [(x["anchor"], x["anchor"] + x["sides"]) for x in blocks if x["state"] < 2]
                found = _starts(len(data), known, length)
                if found:
                    runs(key, np.array(found, "<i8").tobytes())
                number = len(keys)
                keys.append(key)
                for a, b in _starts(len(data), spans, length):
                    for c in range(a, b + 1, PIECE):
                        d = min(b, c + PIECE - 1)
                        n = names(data[c : d + length], half)
                        x, y = n[:-half], n[half:]
                        hi.append(_pair(x, y))
                        lo.append(((x ^ (y * _A)) >> np.uint64(32)).astype(np.uint32))
                        at.append(np.arange(c, d + 1, dtype=np.int64))
                        which.append(np.full(d + 1 - c, number, np.int64))
                        count += d + 1 - c
                        if count >= FLUSH:
                            yield flush()
                            count, number = 0, 0
                            keys.append(key)
        if count or rows:
            yield flush()

    return texts.select("tkey", "text", "places", "blocks").mapInArrow(run, PACKS)


def _resolve(packs: DataFrame) -> DataFrame:
    """(tkey, pack): runs of positions of full-length strings that occur elsewhere too."""

    def bucket_of(bucket: int, keys: list[list[bytes]], counts: list[list[int]], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        flat = [k for own in keys for k in own]
        if bucket < 0:
            out = list(zip(flat, blobs))
        else:
            rows = np.frombuffer(b"".join(blobs), KIND)
            number = _numbers(flat)
            which = np.repeat(number, [c for own in counts for c in own])
            at = rows["at"].astype(np.int64)
            sure, _ = _split([rows["hi"], rows["lo"]], [at, which])
            pick = np.flatnonzero(sure)
            by_number = dict(zip(number.tolist(), flat))
            out = [(by_number[int(which[own[0]])], _runs(np.sort(at[own]))) for own in _groups(pick[np.argsort(which[pick], kind="stable")], which)]
        if out:
            k, p = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(p, pa.binary())], ["tkey", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = 0, ([], [], [])
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, *row = (batch.column(c)[i].as_py() for c in range(4))
                if held[0] and (bucket != now or (bucket < 0 and len(held[0]) >= 1000)):
                    yield from bucket_of(now, *held)
                    held = ([], [], [])
                now = bucket
                for x, y in zip(held, row):
                    x.append(y)
        if held[0]:
            yield from bucket_of(now, *held)

    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "tkey binary, pack binary")


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """What is left of each text: (tkey, kept bytes, removed, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, packs in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode("utf-8", "surrogatepass")
                runs = np.concatenate([np.frombuffer(p, "<i8") for p in packs.as_py()]).reshape(-1, 2)
                runs = runs[np.argsort(runs[:, 0], kind="stable")]
                end = np.maximum.accumulate(runs[:, 1]) + length
                new = np.flatnonzero(np.r_[True, runs[1:, 0] > end[:-1]])
                begin, end = runs[new, 0], end[np.r_[new[1:] - 1, len(end) - 1]]
                kept, p = [], 0
                for a, b in zip(begin.tolist(), end.tolist()):
                    kept.append(data[p:a])
                    p = b
                kept.append(data[p:])
                out.append((b"".join(kept), int((end - begin).sum()), len(new)))
            kept, removed, spans = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["tkey", "kept", "n_removed", "n_spans"])

    return texts.select("tkey", "text", "packs").mapInArrow(run, "tkey binary, kept binary, n_removed long, n_spans long")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) where something was removed."""
    if length % 8:
        raise ValueError("length must be a multiple of 8")
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = F.unhex(F.md5(data))
    base = pin(docs.select("doc_id", key.alias("tkey"), F.length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha")), "digests")
    first = pin(_find_anchors(docs, length), "anchors")
    second = pin(_halves(_repeated(first)), "halves")
    by_anchor = (
        _repeated(second)
        .select("tkey", F.expr("(at - side) div 2 + side").alias("anchor"), (F.col("side") + 1).alias("side"), "around", "more")
        .groupBy("tkey", "anchor")
        .agg(F.bit_or("side").alias("sides"), F.first("around").alias("around"), F.first("more").alias("more"))
    )
    left = _wholes(by_anchor).groupBy("tkey").agg(F.collect_set(F.struct("anchor", "sides", "state")).alias("places"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of a task, each once."""
        seen = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            new = [not (k in seen or seen.add(k)) for k in keys]
            yield batch.filter(pa.array(new, pa.bool_()))

    whole = docs.select(key.alias("tkey"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") >= length)
    texts = pin(whole.mapInArrow(once, "tkey binary, text string").join(left.hint("shuffle_hash"), "tkey"), "texts")
    block = _repeated(pin(_blocks(texts, length), "blocks")).select("tkey", F.col("right").alias("anchor"), F.col("side").alias("sides"), "around", "more").distinct()
    block = _wholes(block).groupBy("tkey").agg(F.collect_set(F.struct("anchor", "sides", "state")).alias("blocks"))
    block = pin(block, "block-states")
    n = block.agg(F.coalesce(F.sum(F.size(F.filter("blocks", lambda p: p["state"] < 2))), F.lit(0))).first()[0]
    buckets = max(48, int(n) * BLOCK // BUCKET)
    marks = _resolve(_full_names(texts.join(block, "tkey", "left"), length, buckets)).groupBy("tkey").agg(F.collect_list("pack").alias("packs"))
    cut = _cut(texts.dropDuplicates(["tkey"]).join(marks, "tkey"), length)
    cut = cut.select("tkey", "kept", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha"))
    copies = base.groupBy("tkey").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    out = base.join(copies, "tkey", "left").join(cut, "tkey", "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"),
    )
