import hashlib
from collections import Counter

import numpy as np
import pytest

from candlewick.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for i, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def result(docs, length):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs, length).collect())


@pytest.mark.parametrize("length", [80, 400])
def test_against_brute_force(make_docs, odd_texts, prose, length):
    shared = prose(70, 120)
    texts = [t for t in odd_texts if t is None or len(t) < 50000]
    texts += [prose(71, 60) + shared + prose(72, 20), shared[5:] + prose(73, 90), prose(74, 50) + shared[:390], "ab" * 600, "x" * 400, "x" * 399, "x" * 401, shared + shared]
    base = prose(75, 600)
    for k in range(6):  # near copies, each changed at places of its own
        words = base.split()
        words[40 + 90 * k] = "edit"
        texts.append(" ".join(words))
    assert result(make_docs(texts), length) == brute(texts, length)


def test_nothing_there(make_docs):
    docs = make_docs(["a", None])
    assert sd.remove_repeats(docs.limit(0)).count() == 0
    assert [r[2] for r in result(docs, 400)] == [0, 0]
    with pytest.raises(ValueError):
        sd.remove_repeats(docs, 10)


def test_pieces_of_long_texts_have_all_anchors(monkeypatch, prose):
    data = prose(80, 3000).encode()

    def found():
        out = set()
        for piece, index in sd.Pieces(iter([(b"k", data), (b"l", data[:900])]), 80):
            which, place, _ = sd.anchors(piece, index, 80)
            out |= {(index[i][0], int(p) + index[i][1] - index[i][2]) for i, p in zip(which, place)}
        return out

    whole = found()
    monkeypatch.setattr(sd, "PIECE", 500)
    assert found() == whole


def test_names_tell_strings_apart():
    data = np.random.default_rng(1).integers(0, 3, 4000, dtype=np.uint8)
    for size in (1, 7, 20, 25):
        n = sd.names(data, size)
        by = {}
        for i, x in enumerate(n.tolist()):
            assert by.setdefault(x, data[i : i + size].tobytes()) == data[i : i + size].tobytes()
        assert len(set(n.tolist())) == len({data[i : i + size].tobytes() for i in range(len(n))})
