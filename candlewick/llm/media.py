"""Operator 7: media columns checked by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one
pass over a value; a validator for each format follows the structure from
there, checks lengths and checksums and gives the end of the object. What is
valid at offset 0 is the value's true type, whatever its declared type said;
valid objects further in are embedded media and can be carved out. An object
inside another is reported only if the outer one is a mere container of bytes
(an unknown value), not if it is part of a valid object.

``store_text`` keeps bytes losslessly as the samples of an 8-bit mono WAV;
``read_samples`` gives them back from a value that has been sniffed.

Null values have type null and no objects; empty and unknown values keep the
declared type with ``valid`` false. A very long value is scanned in one pass and
stored whole (up to WAV's 4 GB). Repeated rows each get a row; an empty table
gives no rows; ``inspect`` and ``carve`` keep other columns and replace those that
have the names they add.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 192
RATE = 8000

# Where a format's magic bytes stand and how far they are from its start.
MAGIC = {
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/gif": (b"GIF8", 0),
    "image/bmp": (b"BM", 0),
    "audio/wav": (b"WAVEfmt ", 8),
    "image/webp": (b"WEBPVP8", 8),
    "audio/flac": (b"fLaC", 0),
    "application/ogg": (b"OggS", 0),
    "application/gzip": (b"\x1f\x8b\x08", 0),
    "application/zip": (b"PK\x03\x04", 0),
    "application/pdf": (b"%PDF-", 0),
    "video/mp4": (b"ftyp", 4),
}


def _riff(d: bytes, at: int, kind: bytes) -> int:
    if d[at : at + 4] != b"RIFF" or d[at + 8 : at + 12] != kind:
        return -1
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    p, seen = at + 12, set()
    while p + 8 <= end <= len(d):
        size = struct.unpack_from("<I", d, p + 4)[0]
        seen.add(d[p : p + 4])
        p += 8 + size + size % 2
    need = {b"fmt ", b"data"} if kind == b"WAVE" else set()
    return end if p == end and need <= seen else -1


def _png(d: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(d):
        size = struct.unpack_from(">I", d, p)[0]
        kind, end = d[p + 4 : p + 8], p + 12 + size
        if end > len(d) or (first and kind != b"IHDR") or zlib.crc32(d[p + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return -1
        if kind == b"IEND":
            return end
        p, first = end, False
    return -1


def _jpeg(d: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        mark = d[p + 1]
        if mark == 0xD9:
            return p + 2
        size = struct.unpack_from(">H", d, p + 2)[0]
        if size < 2:
            return -1
        p += 2 + size
        if mark == 0xDA:  # entropy-coded data: up to a marker that is neither stuffing nor a restart
            while True:
                p = d.find(b"\xff", p)
                if p < 0 or p + 1 >= len(d):
                    return -1
                if d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7:
                    p += 2
                elif d[p + 1] == 0xFF:
                    p += 1
                else:
                    break
            if d[p + 1] == 0xD9:
                return p + 2
    return -1


def _gif(d: bytes, at: int) -> int:
    if d[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(d):
        return -1
    flags = d[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(d):
        if d[p] == 0x3B:
            return p + 1
        if d[p] == 0x21:
            p += 2
        elif d[p] == 0x2C and p + 10 < len(d):
            flags = d[p + 9]
            p += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        else:
            return -1
        while p < len(d) and d[p]:
            p += 1 + d[p]
        p += 1
    return -1


def _bmp(d: bytes, at: int) -> int:
    if at + 30 > len(d):
        return -1
    size, spare, start, header = struct.unpack_from("<IIII", d, at + 2)
    planes, depth = struct.unpack_from("<HH", d, at + 26)
    good = spare == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + header <= start <= size
    return at + size if good and at + size <= len(d) else -1


def _flac(d: bytes, at: int) -> int:
    p, first = at + 4, True
    while p + 4 <= len(d):
        head, size = d[p], int.from_bytes(d[p + 1 : p + 4], "big")
        if (first and (head & 0x7F or size != 34)) or p + 4 + size > len(d):
            return -1
        p, first = p + 4 + size, False
        if head & 0x80:
            return len(d) if d[p : p + 1] == b"\xff" else -1
    return -1


def _ogg(d: bytes, at: int) -> int:
    p, end = at, -1
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d):
        n = d[p + 26]
        size = 27 + n + sum(d[p + 27 : p + 27 + n])
        if d[p + 4] or p + size > len(d):
            return -1
        last = d[p + 5] & 4
        p += size
        if last:
            end = p
    return end


def _gzip(d: bytes, at: int) -> int:
    try:
        stream = zlib.decompressobj(31)
        rest = d[at:]
        while rest and not stream.eof:
            stream.decompress(rest, 1 << 20)
            rest = stream.unconsumed_tail
        return len(d) - len(stream.unused_data) if stream.eof else -1
    except zlib.error:
        return -1


def _zip(d: bytes, at: int) -> int:
    p = d.find(b"PK\x05\x06", at)
    while p >= 0 and p + 22 <= len(d):
        size, offset, note = struct.unpack_from("<IIH", d, p + 12)
        if at + offset + size == p and p + 22 + note <= len(d):
            return p + 22 + note
        p = d.find(b"PK\x05\x06", p + 1)
    return -1


def _pdf(d: bytes, at: int) -> int:
    if not (d[at + 5 : at + 6].isdigit() and d[at + 6 : at + 7] == b"."):
        return -1
    p = d.find(b"%%EOF", at)
    return p + 5 if p >= 0 and b"startxref" in d[at:p] else -1


def _mp4(d: bytes, at: int) -> int:
    p, kinds = at, []
    while p + 8 <= len(d):
        size = struct.unpack_from(">I", d, p)[0]
        kind = d[p + 4 : p + 8]
        if size < 8 or p + size > len(d) or not kind.isalnum():
            break
        kinds.append(kind)
        p += size
    return p if kinds[:1] == [b"ftyp"] and (b"moov" in kinds or b"mdat" in kinds) else -1


VALIDATORS = {
    "image/png": _png,
    "image/jpeg": _jpeg,
    "image/gif": _gif,
    "image/bmp": _bmp,
    "audio/wav": lambda d, at: _riff(d, at, b"WAVE"),
    "image/webp": lambda d, at: _riff(d, at, b"WEBP"),
    "audio/flac": _flac,
    "application/ogg": _ogg,
    "application/gzip": _gzip,
    "application/zip": _zip,
    "application/pdf": _pdf,
    "video/mp4": _mp4,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (magic, back) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, back + len(magic) - 1))
    found.make_automaton()
    return found


def sniff(data: bytes, magic: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid objects, outermost only, in order of offset."""
    out, free = [], 0
    for end, (kind, back) in sorted(magic.iter(data.decode("latin-1")), key=lambda x: x[0] - x[1][1]):
        at = end - back
        if at < free:
            continue
        stop = VALIDATORS[kind](data, at)
        if stop > at:
            out.append((kind, at, stop - at))
            free = stop
    return out


OBJECTS = "array<struct<type:string,offset:long,length:long>>"


def inspect(rows: DataFrame, data: str = "media", declared: str = "declared") -> DataFrame:
    """``rows`` with media_type (corrected), valid, and objects (all valid media found, embedded ones included), in place of columns of these names."""
    rows = rows.drop("media_type", "valid", "objects")
    kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        for batch in batches:
            types, valid, objects = [], [], []
            for value, said in zip(batch.column(data), batch.column(declared)):
                value = value.as_py()
                found = None if value is None else sniff(value, magic)
                whole = bool(found) and found[0][1] == 0
                types.append(None if value is None else found[0][0] if whole else said.as_py())
                valid.append(whole)
                objects.append(None if found is None else [{"type": t, "offset": a, "length": n} for t, a, n in found])
            new = [pa.array(types, pa.string()), pa.array(valid), pa.array(objects, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "media_type", "valid", "objects"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{names}, media_type string, valid boolean, objects {OBJECTS}")


def carve(rows: DataFrame, data: str = "media") -> DataFrame:
    """One row for each object of inspected rows, with its bytes as ``object``, in place of columns nth, found and object."""
    one = rows.drop("nth", "found", "object").select("*", F.posexplode("objects").alias("nth", "found"))
    return one.withColumn("object", F.substring(F.col(data), (F.col("found.offset") + 1).cast("int"), F.col("found.length").cast("int")))


def wav(samples: bytes, rate: int = RATE) -> bytes:
    pad = b"\0" * (len(samples) % 2)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(data: bytes) -> bytes:
    """The samples of a valid WAV."""
    p = 12
    while data[p : p + 4] != b"data":
        size = struct.unpack_from("<I", data, p + 4)[0]
        p += 8 + size + size % 2
    return data[p + 8 : p + 8 + struct.unpack_from("<I", data, p + 4)[0]]


def store_text(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text's UTF-8, padded by spaces to a positive multiple of ``block``, as WAV under a type that says nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1)]
            media = [wav(r.ljust(max(1, -(-len(r) // block)) * block)) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "declared", "media"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def read_samples(rows: DataFrame) -> DataFrame:
    """Digests and features of stored samples, for inspected rows of valid WAV."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for media, kind, valid in zip(batch.column("media"), batch.column("media_type"), batch.column("valid")):
                media = media.as_py()
                if not (valid.as_py() and kind.as_py() == "audio/wav"):
                    raise ValueError(f"stored media is not a valid WAV but {kind.as_py()}")
                payload = samples(media)
                x = np.frombuffer(payload, np.uint8)
                count = np.bincount(x, minlength=256) / len(x)
                entropy = -(count[count > 0] * np.log2(count[count > 0])).sum()
                feature = f"{kind.as_py()};samples={len(x)};mean={x.mean():.4f};std={x.std():.4f};crossings={int((np.diff(x >= 128) != 0).sum())};entropy={entropy:.4f}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            a, b, c, d, e, f = zip(*out) if out else ([],) * 6
            arrays = [pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.string()), pa.array(f, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], NAMES)

    return rows.select("doc_id", "n_bytes", "media", "media_type", "valid").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
