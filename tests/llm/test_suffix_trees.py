"""Repeated word windows against a brute-force pass over all windows."""

import hashlib
import os
import random
import re

import numpy as np
import pytest

from candlewick.llm import suffix_trees as st
from candlewick.llm.queries import queries

SF = "/root/testdata/sf0.001"


def brute(rows, window):
    """(n_words, kept words) of each row; documents in order of id (null last), equal rows as one."""
    docs = {}
    for i, text in rows:
        docs.setdefault((i is None, i or 0, text or ""), re.findall("[^\x20\x09-\x0d]+", text or ""))
    seen, out = set(), {}
    for doc in sorted(docs):
        words = docs[doc]
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[doc] = (len(words), [w for w, g in zip(words, gone) if not g])
    return [out[(i is None, i or 0, text or "")] for i, text in rows]


def check(make_docs, texts, ids=None, **options):
    ids = list(range(len(texts))) if ids is None else ids
    found = st.remove_repeated_windows(make_docs(texts, ids), **options).collect()
    want = brute(list(zip(ids, texts)), options.get("window", st.WINDOW))
    expect = sorted((str(i), n, n - len(kept), " ".join(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, (n, kept) in zip(ids, want))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in found) == expect
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in found)
    return expect


@pytest.fixture(scope="module")
def shared_texts(prose):
    passage, copy = prose(100, 60), prose(101, 300)
    texts = [prose(i, 80) + " " + passage + "\n" + prose(50 + i, 40) for i in range(12)]
    texts += [copy] * 8 + [copy + " tail" + str(i) for i in range(8)] + ["la " * 200, "la " * 90, passage, " ".join(passage.split()[3:30]), " ".join(passage.split()[:19])]
    return texts


@pytest.mark.parametrize("limit", [3, 4096])
def test_groups_small_and_large(make_docs, shared_texts, limit):
    assert any(x[2] for x in check(make_docs, shared_texts, limit=limit))


@pytest.mark.parametrize(("window", "gram"), [(1, 1), (2, 1), (5, 3), (7, 7), (20, 2)])
def test_other_lengths(make_docs, shared_texts, window, gram):
    check(make_docs, shared_texts[::3], window=window, gram=gram)


def test_order_of_documents_is_by_id(make_docs, prose):
    texts = [prose(7, 70), prose(8, 10) + " " + prose(7, 70), prose(7, 70)]
    check(make_docs, texts, [9, 4, -3])
    check(make_docs, texts, [None, 2**62, None])


def test_odd_rows(make_docs, odd_texts):
    check(make_docs, odd_texts)
    check(make_docs, odd_texts + odd_texts, [*range(len(odd_texts))] * 2)
    assert st.remove_repeated_windows(make_docs([])).collect() == []


def test_few_words_and_all_spaces(make_docs):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "b", "\x1c", "\xa0", " "]) + r.choice([" ", "\t", "\n\n", "\x0b", " \r "]) for _ in range(r.randrange(120))) for _ in range(40)]
    check(make_docs, texts, window=6, gram=3)
    check(make_docs, texts, window=6, gram=3, limit=5)


def test_a_text_of_many_runs_beside_its_parts(make_docs, prose):
    long = prose(1, 3000)
    check(make_docs, [long, prose(2, 500) + " " + long, long + " " + long])


def test_a_subtree_flags_all_leaves_but_the_earliest():
    words = [b"a b c d", b"x a b c", b"a b c z"]
    mask = st.subtrees(np.zeros(3, np.int64), [np.array([5, 2, 9])], np.array([0, 0, 4]), np.array([2, 2, 2]), words, 3)
    assert mask.tolist() == [1, 0, 1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_query_on_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for (i, _), (n, kept) in zip(rows, brute(rows, 20))}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries()["op11_window_dedup"](spark, SF).collect()} == want
    assert any(w[1] for w in want.values())
