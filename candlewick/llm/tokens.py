"""Operator 8: token ids in compressed binary files.

Documents are put in ascending doc_id order by a range partitioning (nulls
first, equal ids by their text's digest), encoded by a given public tokenizer,
closed by an end id, and written as segments: runs of whole documents whose ids
go through the range coder of ``token_codec`` in checksummed blocks that can be
decoded alone. A segment is a row of a Parquet table with its documents' ids
and lengths beside the coded bytes, so Spark's readers and writers carry it to
any store. Reading gives the ids back and verifies every block.

Words between white space are told apart and looked up by Arrow, encoded once,
many at a call, and remembered (this tokenizer drops white space, which for it
is Unicode's and not U+001C to U+001F, and never joins over it; texts with a
special token's text are encoded whole). A position in the whole corpus is the
sum of the segments before it, from a small table of segment sizes.

Null and empty texts are just the end id; a very long text is one document of
one segment, in as many blocks as it needs; repeated rows are documents of their
own; an empty table gives no rows; other columns are ignored, whatever they are
called.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import token_codec
from .common import shared_path, tidy

TOKENIZER = "word_bpe_49k.json"
END = 2
SEGMENT = 4_000_000
CACHE = 800_000
BATCH = 8192
#: Words told apart at once.
RUN = 1 << 16
#: Bytes of words for one call of the merges.
CALL = 1 << 13
#: Bytes of text for each task, however large the input.
PARTITION = 64 << 20
# Python counts these as white space, the tokenizer does not: it gives them ids.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACE = re.compile(rf"[^\S{SEPARATORS}]+")
# For Arrow's regular expressions: runs of letters in lower case and, behind them, of marks.
LETTERS = "[a-z\xdf-\xf6\xf8-\xff]+"
MARKS = r"[.,!?;:|#$%&*+\-/<=>@\\^_`~()\[\]{}\"]"
ODD = re.compile("[^\0-\x1b\x20-\x84\x86-\x9f\xa1-\xff]")
SEGMENTS = "part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, data binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class _Known:
    """The ids of words without white space that were met so far, laid end to end; new ones are encoded when they are looked up.

    A word in lower case is a run of letters, as the tokenizer's pattern cuts it,
    with marks behind it that are a run of their own: the letters go straight
    to the tokenizer's merges, many words at a call. Any other word goes through
    the whole tokenizer.
    """

    # The bytes of these letters' UTF-8 as the byte-level vocabulary writes them: those that print stand for themselves, the
    # others from 256 on. Of the letters' bytes only these three do not print.
    WRITTEN = {"\x9f": chr(256 + 65), "\xa0": chr(256 + 66), "\xad": chr(256 + 67)}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The library's own memory of words is of no use: no word is asked for twice.
        self.tokenizer.model._resize_cache(0)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # The ids that close a word.
        words = self.tokenizer.get_vocab()
        self.closing = np.zeros(1 << 16, bool)
        self.closing[[i for word, i in words.items() if word.endswith(self.tokenizer.model.end_of_word_suffix or "\n")]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.uint16)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.uint16) for x in words]

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def _add_letters(self, words: pa.Array) -> None:
        """Words of letters alone, CALL bytes or one word at a call of the merges."""
        size = pc.binary_length(words).to_numpy()
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // CALL)) + 1
        calls = pa.ListArray.from_arrays(np.r_[0, cuts, len(words)].astype(np.int32), words)
        ids, sizes = [], []
        for own, joined in zip(calls, pc.binary_join(calls, pa.scalar(" ", pa.large_string()))):
            text = joined.as_py()
            if not text.isascii():
                text = text.encode().decode("latin-1")
                for byte, written in self.WRITTEN.items():
                    text = text.replace(byte, written)
            found = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
            last = np.flatnonzero(self.closing.take(found))
            if len(last) != len(own) or last[-1] != len(found) - 1:
                # No vocabulary that marks the ends of words: word by word.
                each = self.encode(own.values.to_pylist())
                found, last = np.concatenate(each), np.cumsum([len(x) for x in each]) - 1
            ids.append(found)
            sizes.append(np.diff(last, prepend=-1))
        self._add(words, np.concatenate(ids), np.concatenate(sizes))

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` those of each of the different words start, and how many they are."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count and len(self.words) + at.null_count > CACHE:
            self.clear()
            at = pa.nulls(len(words), pa.int32())
        new = words.filter(at.is_null())
        letters = pc.match_substring_regex(new, rf"^{LETTERS}\z")
        at = at.fill_null(-1).to_numpy().copy()
        plain, other = new.filter(letters), new.filter(pc.invert(letters))
        missing, is_plain = np.flatnonzero(at < 0), letters.to_numpy(zero_copy_only=False).astype(bool)
        for chosen, which in ((plain, is_plain), (other, ~is_plain)):
            if len(chosen):
                at[missing[which]] = len(self.words) + np.arange(len(chosen))
                if chosen is plain:
                    self._add_letters(chosen)
                else:
                    each = self.encode(chosen.to_pylist())
                    self._add(chosen, np.concatenate(each), np.array([len(x) for x in each], np.int64))
        return self.starts.take(at), self.sizes.take(at)


def _laid(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` at these places, end to end."""
    after = np.cumsum(sizes)
    return flat.take(np.repeat(starts - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0))


_known: dict[str, _Known] = {}


def encoder(path: str):
    """A function from texts to arrays of ids. What words encode to is remembered for the life of the process.

    The words of a batch of texts are found and told apart by Arrow; each
    different word is looked up once.
    """
    if path not in _known:
        _known[path] = _Known(path)
    known = _known[path]
    special = [t.content for t in known.tokenizer.get_added_tokens_decoder().values()]

    def by_words(words: pa.Array, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of texts, with the end id: text i has the words from offsets[i] to offsets[i + 1]."""
        # Words are told apart in runs whose different words fit a processor's cache, then all together.
        found = [words.slice(i, RUN).dictionary_encode() for i in range(0, len(words), RUN)] or [words.dictionary_encode()]
        before = np.cumsum([0, *(len(x.dictionary) for x in found)])
        which = np.concatenate([x.indices.to_numpy() + n for x, n in zip(found, before)])
        different = pa.concat_arrays([x.dictionary for x in found])
        letters, marks = pc.extract_regex(different, rf"^(?P<letters>{LETTERS})(?P<marks>{MARKS}+)\z").flatten()
        pieces = pa.concat_arrays([pc.coalesce(letters, different), marks.fill_null("")]).dictionary_encode()
        pair = pieces.indices.to_numpy().reshape(2, -1).T
        starts, sizes = (x.take(pair) for x in known.look_up(pieces.dictionary))
        own = _laid(known.ids, starts.reshape(-1), sizes.reshape(-1))
        sizes = sizes.sum(axis=1)
        lengths = sizes.take(which)
        ids = _laid(own, (np.cumsum(sizes) - sizes).take(which), lengths)
        ends = np.r_[0, np.cumsum(lengths)].take(offsets[1:])
        return np.split(np.insert(ids, ends, END), ends[:-1] + np.arange(1, len(ends)))

    def plain(texts: list[str]) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        offsets = words.offsets.to_numpy()
        return by_words(words.flatten(), offsets - offsets[0])

    def odd(texts: list[str]) -> list[np.ndarray]:
        words = [pa.array(SPACE.split(t), pa.large_string()) for t in texts]
        return by_words(pa.concat_arrays(words), np.r_[0, np.cumsum([len(own) for own in words])])

    def run(texts: list[str]) -> list[np.ndarray]:
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, t in enumerate(texts):
            # Arrow lowers and splits the characters of plain texts as the tokenizer does.
            kinds[2 if "<|" in t and any(s in t for s in special) else 1 if (any(c in t for c in SEPARATORS) if t.isascii() else ODD.search(t)) else 0].append(i)
        out: list = [None] * len(texts)
        for own, ids_of in zip(kinds, (plain, odd, lambda whole: [np.append(x, np.uint16(END)) for x in known.encode(whole)])):
            if own:
                for i, ids in zip(own, ids_of([texts[i] for i in own]), strict=True):
                    out[i] = ids
        return out

    return run


def segments(docs: DataFrame, tokenizer: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Coded segments of the documents in order of doc_id."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    rows = rows.repartitionByRange(n, *key).sortWithinPartitions(*key)
    rows = rows.withColumn("part", F.spark_partition_id())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path)
        seq, size, ids, docs_in = 0, 0, [], []

        def close(part: int) -> pa.RecordBatch:
            whole = np.concatenate(ids)
            data = b"".join(token_codec.encode(whole))
            lengths = [len(x) for x in ids]
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(whole)], pa.int64()), pa.array([docs_in], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_tokens", "doc_ids", "lengths", "data"])

        part = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                piece = batch.slice(at, BATCH)
                part = piece.column(2)[0].as_py()
                for doc, own in zip(piece.column(0).to_pylist(), encode([t or "" for t in piece.column(1).to_pylist()])):
                    docs_in.append(doc)
                    ids.append(own)
                    size += len(own)
                    if size >= segment:
                        yield close(part)
                        seq, size, ids, docs_in = seq + 1, 0, [], []
        if ids:
            yield close(part)

    return rows.mapInArrow(run, SEGMENTS)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, segment: int = SEGMENT) -> None:
    segments(docs, tokenizer, segment).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, part, seq, nth, ids."""
    return _documents(spark.read.parquet(path), "ids array<int>", lambda own: pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))


def _documents(files: DataFrame, last: str, make) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, docs, lengths, data in zip(*(batch.column(c) for c in ("part", "seq", "doc_ids", "lengths", "data"))):
                ids = token_codec.decode(data.as_py())
                docs, lengths = docs.values, lengths.values.to_numpy()
                if len(ids) != lengths.sum():
                    raise ValueError("a segment's documents do not add up to its ids")
                ends = np.cumsum(lengths)
                for a in range(0, len(lengths), 1024):
                    own = [ids[e - n : e] for e, n in zip(ends[a : a + 1024], lengths[a : a + 1024])]
                    m = len(own)
                    columns = [docs.slice(a, m), pa.array([part.as_py()] * m, pa.int32()), pa.array([seq.as_py()] * m, pa.int32()), pa.array(ends[a : a + m] - lengths[a : a + m]), pa.array(lengths[a : a + m]), make(own)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "seq", "offset", "n_tokens", last.split()[0]])

    return files.mapInArrow(run, f"doc_id long, part int, seq int, offset long, n_tokens long, {last}")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start in the corpus, n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    crc = _documents(files, "ids_crc32 long", lambda own: pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before_part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)))
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("before_part") + F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))).alias("before"))
    # One row for each segment of SEGMENT ids.
    return crc.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("offset")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def write_and_check(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents to new files in the shared folder and read their digests back."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write(docs, path, tokenizer)
    return digests(spark, path)
