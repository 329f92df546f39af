"""Operator 1: benchmark decontamination by winnowing, with DataFrame functions only.

A text is lower-cased (A-Z only) and cut into words; a benchmark item's windows
are its runs of ``window`` words, or the whole item if it is shorter. Of the
``window - gram + 1`` word k-grams of a window, winnowing keeps the smallest
hash. Equal windows keep equal hashes, so a document that shares a window with
an item also shares its kept hash: none is missed. The documents' kept hashes,
each with the words around it, are joined with the benchmark's, and a hit is
extended over the words of every window that may have kept the hash.

Items shorter than the window are winnowed with the whole item as the k-gram,
which keeps every position.

The benchmark is broadcast only while it has at most ``broadcast_windows``
windows; above that the same join is a shuffle join on the hash, whose hot
keys adaptive execution splits. Documents are scanned once and their texts are
never shuffled.

Null and empty texts have no words and are clean; an item without words
matches nothing; items with a null id mark words but are not listed; two items
with one id count once; repeated document rows each get a row; a word is hit
once however many windows cover it. Empty tables give all documents as clean,
or no rows. Columns other than doc_id, item_id and text are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
BROADCAST_WINDOWS = 1_000_000


def words(text: str | Column = "text") -> Column:
    """Words of a text with A-Z in lower case; none for a null text."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _gram(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(hashes, at + i) for i in range(size)])


def _numbers(n: Column) -> Column:
    """0 to n - 1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, size: int) -> Column:
    return F.transform(_numbers(F.size(hashes) - size + 1), lambda i: _gram(hashes, i, size))


def _kept(grams: Column, span: int) -> Column:
    """The smallest of each ``span`` consecutive hashes."""
    if span == 1:
        return grams
    return F.transform(_numbers(F.size(grams) - span + 1), lambda i: F.least(*[F.get(grams, i + j) for j in range(span)]))


def windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """Distinct windows of the items: length, kept hash, word hashes, ids of the items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _hashes(words()).alias("h")).filter(F.size("h") > 0)
    long = items.filter(F.size("h") >= window).select(
        "item",
        F.lit(window).alias("len"),
        F.explode(F.transform(_numbers(F.size("h") - window + 1), lambda i: F.slice("h", i + 1, window))).alias("win"),
    )
    out = long.select("item", "len", "win", let(_grams(F.col("win"), gram), lambda g: F.array_min(g)).alias("kept"))
    short = items.filter(F.size("h") < window)
    for size in range(1, window):
        out = out.unionByName(
            short.filter(F.size("h") == size).select("item", F.lit(size).alias("len"), F.col("h").alias("win"), _gram(F.col("h"), F.lit(0), size).alias("kept"))
        )
    return out.groupBy("kept", "len", "win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _seeds(h: Column, window: int, gram: int, short: list[int]) -> Column:
    """Where a text's kept hashes change, with the words of the windows that may have kept them."""
    span = window - gram + 1

    def long_of(kept: Column) -> Column:
        starts = F.filter(
            _numbers(F.size(kept)),
            lambda i: (i % span == 0) | (F.get(kept, i) != F.get(kept, i - 1)),
        )
        return F.transform(
            starts,
            lambda i: F.struct(i.alias("at"), F.get(kept, i).alias("kept"), F.lit(window).alias("len"), F.slice(h, i + 1, window + span - 1).alias("near")),
        )

    def short_of(size: int) -> Column:
        return F.transform(
            _numbers(F.size(h) - size + 1),
            lambda i: F.struct(i.alias("at"), _gram(h, i, size).alias("kept"), F.lit(size).alias("len"), F.slice(h, i + 1, size).alias("near")),
        )

    out = let(_grams(h, gram), lambda g: let(_kept(g, span), long_of))
    for size in short:
        out = F.concat(out, short_of(size))
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, hits (sorted word positions), items (sorted ids)."""
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    wins = windows(benchmark, window, gram)
    known = wins.groupBy("len").count().collect()  # at most `window` rows
    short = sorted(r.len for r in known if r.len < window)
    few = sum(r["count"] for r in known) <= broadcast_windows
    wins = wins.select(F.col("kept").alias("w_kept"), F.col("len").alias("w_len"), "win", "items")
    if few:
        wins = F.broadcast(wins)

    head = lambda n: F.struct(F.lit(-1).alias("at"), F.xxhash64("doc_id", "__t").alias("kept"), n.alias("len"), F.lit(None).cast("array<bigint>").alias("near"))
    seeds = docs.select("doc_id", F.xxhash64("text").alias("__t"), words().alias("__w"))
    seeds = seeds.select("doc_id", "__t", F.explode(let(_hashes(F.col("__w")), lambda h: F.concat(F.array(head(F.size(h))), _seeds(h, window, gram, short)))).alias("s"))
    seeds = seeds.select("doc_id", "__t", "s.*")
    hit = seeds.join(wins, (F.col("kept") == F.col("w_kept")) & (F.col("len") == F.col("w_len")), "left")
    hit = hit.filter((F.col("at") < 0) | F.col("win").isNotNull())
    same = F.filter(_numbers(F.size("near") - F.size("win") + 1), lambda j: F.slice("near", j + 1, F.size("win")) == F.col("win"))
    hit = hit.select("doc_id", "__t", "at", F.when(F.col("at") < 0, F.col("len")).alias("n_words"), F.col("w_len"), F.when(F.col("at") >= 0, same).alias("same"), "items")
    hit = hit.filter((F.col("at") < 0) | (F.size("same") > 0)).select(
        "doc_id",
        "__t",
        "n_words",
        F.when(
            F.col("at") >= 0,
            F.array_distinct(F.flatten(F.transform("same", lambda j: F.sequence(F.col("at") + j, F.col("at") + j + F.col("w_len") - 1)))),
        ).alias("pos"),
        F.when(F.col("at") >= 0, F.col("items")).alias("items"),
    )
    found = hit.groupBy("doc_id", "__t").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("__copies"),
        F.array_distinct(F.flatten(F.collect_set("pos"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    found = found.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return found.select("doc_id", "__t", F.col("n_words").cast("long").alias("n_words"), F.sort_array("hits").alias("hits"), F.sort_array("items").alias("items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that share a window with the benchmark."""
    dirty = find(docs, benchmark, **options).filter(F.size("hits") > 0).select(F.col("doc_id").alias("hit_id"), F.col("__t").alias("hit_text")).distinct()
    rows = boxed(docs, id=F.col("doc_id"), text=F.xxhash64("text"))
    return rows.join(dirty, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text") == F.col("hit_text")), "left_anti").select("row.*")
