"""The registered queries, as the driver calls them, on a whole small table against rules worked out here."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from test_decontamination import brute as brute_windows
from test_simhash import brute_components, brute_fingerprint

from candlewick.llm.queries import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, start):
    name = next(n for n in queries() if n.startswith(start))
    return queries()[name](spark, SF).collect()


def test_op1(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i: (n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)) for i, n, hit, found in brute_windows(docs.items(), items)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows(spark, "op1_")} == want
    assert any(w[4] for w in want.values())


def test_op2(spark, docs):
    ids = sorted(docs)
    fps = [brute_fingerprint(docs[i]) for i in ids]
    want = {i: (f"{fp:016x}", ids[k]) for i, fp, k in zip(ids, fps, brute_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op2_")} == want


@pytest.mark.parametrize(("start", "threshold"), [("op3_", 0.3), ("op5_", 0.5)])
def test_classifiers(spark, docs, start, threshold):
    found = rows(spark, start)
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


def test_op4(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = rows(spark, "op4_")
    assert {r.page_id: r.url for r in found} == pages and all(r.n_chars == len(r.text) for r in found)


def test_op6(spark, docs):
    data = {i: (t or "").encode() for i, t in docs.items()}
    names = {i: [xxhash.xxh3_128_intdigest(b[p : p + 400]) for p in range(len(b) - 399)] for i, b in data.items()}
    count = Counter(n for own in names.values() for n in own)
    want = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, int)
        for p, n in enumerate(names[i]):
            if count[n] > 1:
                gone[p : p + 400] = 1
        kept = np.frombuffer(b, np.uint8)[gone[: len(b)] == 0].tobytes()
        want[i] = (len(b), len(b) - len(kept), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op6_")} == want
    assert any(w[1] for w in want.values())


def test_op7(spark, docs):
    for r in rows(spark, "op7_"):
        b = (docs[r.doc_id] or "").encode()
        payload = b.ljust(max(192, -(-len(b) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_op8(spark, docs):
    from tokenizers import Tokenizer

    from candlewick.llm import tokens

    tokenizer, at, want = Tokenizer.from_file(tokens.default_tokenizer()), 0, {}
    for i in sorted(docs):
        own = np.array([*tokenizer.encode(docs[i] or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op8_")} == want


def test_op9_and_op10(spark, docs):
    mixed = rows(spark, "op9_")
    assert {r.doc_id: r.size for r in mixed} == {i: len((t or "").split()) for i, t in docs.items()}
    assert all(r.taken in (0, r.size, 2 * r.size) and r.target <= 2 * r.source_size + 1e-6 for r in mixed)
    sharded = rows(spark, "op10_")
    assert {r.doc_id: (r.size, r.text_crc32) for r in sharded} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs.items()}
    by = {}
    for r in sharded:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
