import zlib

import numpy as np
import pyarrow as pa
import pytest

from candlewick.llm import token_codec, tokens


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 2047, 2048, 2049, 9000])
def test_round_trips(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 65536, n), np.repeat(r.integers(0, 40, n // 5 + 1), 5)[:n], np.full(n, 65535), (r.zipf(1.3, n) % 49408)):
        blocks = token_codec.encode(ids)
        assert (token_codec.decode(b"".join(blocks)) == ids).all()


def test_blocks_stand_alone_and_are_checked():
    ids = np.random.default_rng(1).integers(0, 3000, 7000)
    blocks = token_codec.encode(ids, 1024)
    for i, b in enumerate(blocks):
        assert (token_codec.decode(b) == ids[i * 1024 : (i + 1) * 1024]).all()
    bad = bytearray(blocks[2])
    bad[40] ^= 1
    with pytest.raises(ValueError):
        token_codec.decode(bytes(bad))
    with pytest.raises(ValueError):
        token_codec.decode(blocks[0][:-2])
    with pytest.raises(ValueError):
        token_codec.encode(np.array([1 << 16]))


@pytest.mark.parametrize("lanes", [1, 3, 64])
def test_lanes(monkeypatch, lanes):
    monkeypatch.setattr(token_codec, "LANES", lanes)
    ids = np.random.default_rng(lanes).zipf(1.2, 5000) % 49408
    assert (token_codec.decode(b"".join(token_codec.encode(ids, 3001))) == ids).all()


def test_no_broken_byte_gives_other_ids():
    ids = np.random.default_rng(4).integers(0, 900, 150)
    data = token_codec.encode(ids)[0]
    noticed = 0
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 16
        try:
            assert (token_codec.decode(bytes(bad)) == ids).all()
        except ValueError:
            noticed += 1
    # Only low bits of a lane's last digit say nothing.
    assert noticed >= len(data) - 2


def test_fewer_bits_than_order_0_and_zlib():
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    ids = np.concatenate(tokens.encoder(tokens.default_tokenizer())(texts))
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    bits = 8 * sum(map(len, token_codec.encode(ids))) / len(ids)
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids) - 0.5
    assert bits < -(share * np.log2(share)).sum() - 0.5


def test_predictable_ids_cost_little():
    assert 8 * sum(map(len, token_codec.encode(np.tile(np.arange(50), 400)))) / 20000 < 2


def test_files(spark, make_docs, odd_texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    texts = [*odd_texts, "It's <|endoftext|> é don't  stop\t42", "Über-ÉTÉ ſ"]
    ids = [3, None, 1, 2, 9, 5, 4, 8, 7, 6, 11, 10]
    rows = sorted(tokens.write_and_check(make_docs(texts, ids=ids)).collect(), key=lambda r: r.start)
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
    at = 0
    for r, k in zip(rows, order, strict=True):
        own = np.array([*tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (ids[k], at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert tokens.write_and_check(make_docs(["a"]).limit(0)).count() == 0


def test_segments_and_reading(spark, make_docs, prose, tmp_path):
    docs = make_docs([prose(i, 50) for i in range(40)])
    path = str(tmp_path / "ids")
    tokens.write(docs, path, segment=700)
    assert spark.read.parquet(path).count() > 5
    assert sum(len(r.ids) for r in tokens.read(spark, path).collect()) == sum(r.n_tokens for r in tokens.digests(spark, path).collect())


def test_separators_are_no_white_space(spark, make_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["a\x1cb", "a\x1db \x1e c", "\x1f", "one\x1f two\x1c\x1c three\x85four", " \x1ea b\x1d ", "<|endoftext|>\x1c x", "plain words"]
    rows = sorted(tokens.write_and_check(make_docs(texts)).collect(), key=lambda r: r.start)
    at = 0
    for r, text in zip(rows, texts, strict=True):
        own = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_every_character_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(tokens.default_tokenizer()), tokens.encoder(tokens.default_tokenizer())
    texts = [f"a{chr(c)}b {chr(c)} c" for c in range(0x3100)]
    for text, own in zip(texts, encode(texts), strict=True):
        assert own.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_new_words_go_to_the_merges_many_at_a_call(monkeypatch):
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "_known", {})
    monkeypatch.setattr(tokens, "CALL", 1000)
    monkeypatch.setattr(tokens, "RUN", 300)
    encode, known, calls = tokens.encoder(path), tokens._known[path], []

    class Merges:
        def encode_batch_fast(self, *args, **options):
            calls.append(args)
            return inner.encode_batch_fast(*args, **options)

    inner, known.merges = known.merges, Merges()
    r = np.random.default_rng(7)
    letters = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xDF, 0x100))]
    texts = [" ".join("".join(r.choice(letters, r.integers(1, 12))) + str(r.choice(["", ".", ",", "?!", "'s", "\xf7"])) for _ in range(200)) for _ in range(20)]
    texts += ["", " ", "x" * 5000, "Stra\xdfe STRASSE \u0152uvre oeuvre", texts[0], "it's <|endoftext|> one"]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [x.tolist() for x in encode(texts)] == want
    assert 0 < len(calls) < len({w for t in texts for w in t.split()}) / 20
    before = len(calls)
    assert [x.tolist() for x in encode(texts[::-1])] == want[::-1]
    assert len(calls) == before
    # When there are too many words, all are forgotten.
    monkeypatch.setattr(tokens, "CACHE", 3000)
    assert [x.tolist() for x in encode([*texts, "newone newtwo"])][: len(texts)] == want
    # A vocabulary without ends of words is asked word by word.
    known.clear()
    known.closing[:] = False
    assert [x.tolist() for x in encode(texts)] == want


def test_coding_needs_little_beside_the_ids():
    import tracemalloc

    ids = np.random.default_rng(8).zipf(1.5, 1 << 20) % 3000
    ids = ids.astype(np.uint16)
    for work in (lambda: b"".join(token_codec.encode(ids)), lambda: token_codec.decode(data)):
        tracemalloc.start()
        data = work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 42 * len(ids)
    assert (data == ids).all()


def test_workers_give_their_memory_back(spark, make_docs):
    """What a task needed while it ran is not held by its worker afterwards."""
    r = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    docs = make_docs([" ".join(words[r.integers(0, 5000, 40_000)]) for _ in range(60)]).coalesce(1)

    def look(batches):
        import os
        import re
        import time

        time.sleep(0.5)
        for _ in batches:
            with open("/proc/self/smaps_rollup") as lines:
                mb = int(re.search(r"\nPss_Anon:\s+(\d+)", lines.read())[1]) >> 10
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([mb])], ["pid", "mb"])

    held = lambda: {x.pid: x.mb for x in spark.range(0, 8, 1, 8).mapInArrow(look, "pid long, mb long").collect()}
    tokens.segments(docs.limit(1)).collect()
    before = held()
    assert sum(x.n_tokens for x in tokens.segments(docs).collect()) > 60 * 40_000
    assert max(mb - before.get(pid, min(before.values())) for pid, mb in held().items()) < 60
