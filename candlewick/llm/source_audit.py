"""Operator 12: how far each source's words are from those of the other sources of its language.

A term is a run of letters (ASCII letters, lower-cased, and all characters beyond
ASCII). Each language keeps the terms that ``least`` of its documents have. With
``count`` occurrences of a term in a group and N of all kept terms there, its share
is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), V being the language's kept terms.
Two distributions differ by the sum of abs(p - q) over all kept terms.

Terms are counted inside each task before anything is shuffled, so what moves
is a row for each group, term and batch, however often a term occurs. The kept terms of
a language are dealt into blocks of about BLOCK, its sources into tiles of about TILE.
A unit of work is a block and a pair of tiles: two dense int64 matrices, group
by term, of which all pairs of rows are compared at once by broadcasting. Units give
partial sums for pairs, which Spark adds up, and, for each group, a heap of
the block's ``top`` terms with the largest excess over the language; the heaps are merged.
No group, block or language is ever in one task as a whole.

Arithmetic is exact: the division is done by thousands, so it holds for any N + 5 V
below 9 * 10^15.

Null text, lang and source count as ''. Groups without a term take part with counts of
zero. Every row is a document, so repeated rows count repeatedly; ties in value rank by
item in UTF-8 order. A very long text takes memory in proportion in its own task.
Other columns are ignored, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pin

LEAST = 30
TOP = 50
BLOCK = 2048
TILE = 64
PIECE = 1 << 22

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def counted(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(group, term number, occurrences, documents) of each group's terms, as three arrays of equal length and ``documents``, and the terms by number."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    letter = _LETTER[raw]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    places = np.flatnonzero(begins)
    ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1 if len(raw) else places
    offsets = np.concatenate([[0], np.cumsum(ends - places)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[letter]])]).dictionary_encode()
    terms, n = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(begin, places, side="right") - 1
    once, times = np.unique(text * n + terms, return_counts=True)
    by, back = np.unique(group[once // n] * n + once % n, return_inverse=True)
    return by // n, by % n, np.bincount(back, times, len(by)).astype(np.int64), np.bincount(back, minlength=len(by)), coded.dictionary.to_pylist()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences of a term in a group, and the documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            names = list(dict.fromkeys(pairs))
            number = {p: i for i, p in enumerate(names)}
            group = np.array([number[p] for p in pairs], np.int64)
            at = size = 0
            texts = [t.as_buffer() for t in batch.column(2)]
            for i, t in enumerate(texts):
                size += t.size
                if size >= PIECE or i + 1 == len(texts):
                    g, term, times, have, words = counted([x.to_pybytes() for x in texts[at : i + 1]], group[at : i + 1])
                    at, size = i + 1, 0
                    strings = pa.array(words, pa.binary()).cast(pa.string())
                    columns = [pa.array([names[k][0] for k in g.tolist()], pa.string()), pa.array([names[k][1] for k in g.tolist()], pa.string()), strings.take(pa.array(term)), pa.array(times), pa.array(have)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), by rows of a group each; exact in int64."""
    base = (total + 5 * kept)[:, None]
    rest = counts + 5
    out = rest // base
    rest = rest - out * base
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // base
        rest = rest % base
    return out + 1


def _unit(top: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, left_tile, right_tile = key
        whole = rows[rows.side == 2]
        terms = sorted(whole.terms.iloc[0]) if len(whole) and whole.terms.iloc[0] is not None else []
        at = {t: i for i, t in enumerate(terms)}
        kept = int(rows.v.iloc[0])

        def matrix(some: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            counts = np.zeros((len(some), len(terms)), np.int64)
            for i, (names, values) in enumerate(zip(some.terms, some.counts)):
                if names is not None and len(names):
                    counts[i, [at[t] for t in names]] = values
            return counts, shares(counts, some.n.to_numpy(np.int64), kept) if terms else counts

        left = rows[rows.side == 0].sort_values("source")
        counts, p = matrix(left)
        a = left.source.tolist()
        out: list[tuple] = []
        if left_tile == right_tile:
            b, q = a, p
        else:
            right = rows[rows.side == 1].sort_values("source")
            b, q = right.source.tolist(), matrix(right)[1]
        slab = max(1, (1 << 22) // max(1, len(b) * len(terms)))
        for i in range(0, len(a), slab):
            apart = np.abs(p[i : i + slab, None, :] - q[None, :, :]).sum(axis=2)
            for k, row in enumerate(apart.tolist()):
                out += [("pair", a[i + k], b[j], value) for j, value in enumerate(row) if left_tile != right_tile or j > i + k]
        if left_tile == right_tile and terms:
            q = matrix(whole)[1][0]
            for i, name in enumerate(a):
                more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                excess = p[i][more] - q[more]
                best = np.lexsort((more, -excess))[:top]
                out += [("term", name, terms[more[k]], int(excess[k])) for k in best]
        frame = pd.DataFrame(out, columns=["part", "source", "item", "value"])
        frame.insert(0, "lang", lang)
        return frame.astype({"value": "int64"})

    return run


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other source of the language by distance, part ``term`` the ``top`` terms by excess over the language."""
    cells = pin(term_counts(docs), "cells")
    terms = cells.groupBy("lang", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term", "count")
    terms = pin(terms, "terms")
    kept = pin(cells.select("lang", "source", "term", "count").join(terms.select("lang", "term"), ["lang", "term"]), "kept")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).groupBy("lang", "source").agg(F.lit(1).alias("one")).select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("count").alias("n_lang")), "lang", "left")
    langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"), F.ceil(F.col("groups") / tile).cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("v") / block)).cast("int").alias("blocks"))
    langs = pin(langs, "langs")
    block_of = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    packed = F.collect_list("term").alias("terms"), F.collect_list("count").alias("counts")
    # Every group has a row in every block of its language, with or without terms there.
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    grid = groups.join(langs.drop("n_lang"), "lang").join(own, ["lang", "source"], "left").select("lang", "source", "v", F.coalesce("n", F.lit(0)).alias("n"), F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile"), "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    filled = kept.join(langs.select("lang", "blocks"), "lang").select("lang", "source", block_of, "term", "count").groupBy("lang", "source", "block").agg(*packed)
    rows = grid.join(filled, ["lang", "source", "block"], "left")
    # Tile t is the left one of the pairs (t, t) and beyond, the right one of the pairs before.
    pair = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))
    t = F.col("tile")
    units = F.concat(F.transform(F.sequence(t, F.col("tiles") - 1), lambda b: pair(t, b, 0)), F.transform(F.filter(F.sequence(F.lit(0), t), lambda a: a < t), lambda a: pair(a, t, 1)))
    rows = rows.select("lang", "block", "source", "n", "v", "terms", "counts", F.explode(units).alias("u"))
    whole = terms.join(langs, "lang").select("lang", "v", "n_lang", "tiles", block_of, "term", "count").groupBy("lang", "block").agg(F.first("v").alias("v"), F.first("n_lang").alias("n"), F.first("tiles").alias("tiles"), *packed)
    tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    all_pairs = F.flatten(F.transform(tiles, lambda a: F.transform(F.filter(tiles, lambda b: b >= a), lambda b: pair(a, b, 2))))
    whole = whole.select("lang", "block", F.lit("").alias("source"), "n", "v", "terms", "counts", F.explode(all_pairs).alias("u"))
    work = rows.unionByName(whole).select("lang", "block", "u.a", "u.b", "u.side", "source", "n", "v", "terms", "counts")
    found = pin(work.groupBy("lang", "block", "a", "b").applyInPandas(_unit(top), "lang string, part string, source string, item string, value long"), "units")
    sums = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p")
    pairs = sums.select("lang", both, "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    heaps = found.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by))
    return ranked(pairs).unionByName(ranked(heaps).filter(F.col("rank") <= top))
