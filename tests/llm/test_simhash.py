import random

import numpy as np
import pytest
import xxhash

from candlewick.llm import simhash as sh


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_texts):
    for text in odd_texts:
        assert sh.fingerprint(text) == brute_fingerprint(text)


def brute_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_components_of_planted_fingerprints(spark):
    r = np.random.default_rng(5)
    fps = [int(x) for x in r.integers(0, 2**63, 60, dtype=np.uint64)]
    for x in list(fps[:10]):
        y = x
        for _ in range(12):  # chains and clusters of near fingerprints
            for bit in r.choice(64, 2, replace=False):
                y ^= 1 << int(bit)
            fps.append(y)
    rows = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in set(fps)], "fp long")
    order = sorted(set(fps), key=lambda f: int(np.uint64(f).astype(np.int64)))
    want = brute_components(order)
    for tile in (4, 2048):
        roots = {r.node: r.root for r in sh.components(sh.links(rows, tile=tile)).collect()}
        signed = [int(np.uint64(f).astype(np.int64)) for f in order]
        assert [roots.get(s, s) for s in signed] == [signed[k] for k in want]


def test_documents(make_docs, odd_texts, prose):
    base = prose(50, 400)
    near = base.replace(base.split()[200], "changed", 1)
    texts = [*odd_texts, base, near, base]
    rows = {r.doc_id: r for r in sh.near_duplicates(make_docs(texts)).collect()}
    assert len(rows) == len(texts)
    fps = [brute_fingerprint(t) for t in texts]
    assert [rows[i].component_id for i in range(len(texts))] == brute_components(fps)
    kept = sorted(r.doc_id for r in sh.keep_one(make_docs(texts)).collect())
    assert kept == sorted(set(brute_components(fps)))


def test_empty_and_null_ids(make_docs):
    assert sh.near_duplicates(make_docs(["a"]).limit(0)).count() == 0
    rows = sh.near_duplicates(make_docs(["a b c", "a b c", "other words here"], ids=[None, 4, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_one_id_for_different_texts(make_docs, prose):
    docs = make_docs([prose(1, 90), prose(2, 90), prose(1, 90), prose(3, 90)], ids=[1, 1, 1, 2])
    assert sorted(r.text for r in sh.keep_one(docs).collect()) == sorted([prose(1, 90), prose(2, 90), prose(3, 90)])


def brute_copies(texts, similarity=0.8):
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_planted_near_copies(spark, make_docs, odd_texts, prose):
    import corpus_pipeline as cp

    r, texts = np.random.default_rng(3), list(odd_texts)
    for i in range(25):  # copies with some words changed, of several lengths, chains of copies of copies, and texts just too far
        words = prose(100 + i, int(r.integers(40, 500))).split()
        texts.append(" ".join(words))
        for k in range(8):
            words = list(words if k % 2 else texts[-1].split())
            for at in r.choice(len(words), max(1, len(words) * (k + 1) // 300), replace=False):
                words[at] = f"new{k}"
            texts.append(" ".join(words))
    texts += [prose(7, 5), prose(7, 6), "two words", "TWO  words"]
    want = brute_copies(texts)
    assert len(set(brute_components([brute_fingerprint(t) for t in texts]))) > len(set(want))
    docs = make_docs(texts)
    for tile in (3, 2048):
        rows = {x.doc_id: x.component_id for x in sh.near_copies(docs, tile=tile).collect()}
        assert [rows[i] for i in range(len(texts))] == want
    assert sorted(x.doc_id for x in cp.near_duplicates_stage(spark, docs, "").collect()) == sorted(set(want))
    assert sh.keep_one_copy(docs.limit(0)).count() == 0


def test_counts_of_shared_shingles_and_spanning_links():
    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(0, 4000, size=n)) for n in (1, 30, 2500, 2500, 3, 900)]
    owner, hashes = np.repeat(np.arange(6), [len(x) for x in sets]), np.concatenate(sets)
    left, right = np.array([0, 5]), np.array([1, 2, 3, 4])
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    assert sh.shared_counts(owner, hashes, left, right).tolist() == want
    child, parent = sh.spanning(np.array([5, 1, 2, 3]), np.array([1, 2, 1, 4]), 7)
    assert {*zip(child.tolist(), parent.tolist())} == {(2, 1), (4, 3), (5, 1)}


@pytest.mark.parametrize("tile", [5, 1024])
def test_a_group_whose_members_are_alike_in_part(make_docs, prose, tile, monkeypatch):
    """Variants of one text at similarities on both sides of 0.8: links must be those of a comparison of all pairs."""
    monkeypatch.setattr(sh, "TILE_SHINGLES", 600 if tile == 5 else 1 << 20)
    base, r = prose(77, 120).split(), random.Random(4)
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(r.randrange(1, 6)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [set(sh.shingles(t, 5).tolist()) for t in texts]
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    found = {x.doc_id: x.component_id for x in sh.near_copies(make_docs(texts), tile=tile).collect()}
    assert found == {i: min(k for k in range(60) if label[k] == label[i]) for i in range(60)}
    assert 1 < len(set(label)) < 60


def test_the_stage_compares_fingerprints(spark, make_docs, prose, monkeypatch):
    """Near copies whose fingerprints are within 2 bits share a cell by these alone; further texts and texts without words do not."""
    base = prose(51, 400).split()
    changed = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 400, 20)]
    near = next(t for t in changed if 0 < (sh.fingerprint(" ".join(base)) ^ sh.fingerprint(t)).bit_count() <= sh.RADIUS)
    texts = [" ".join(base), near, prose(52, 400), "", None, "  ".join(base).replace("a", "A")]
    rows = sh.sketches(make_docs(texts), sh.COPY_SHINGLE).cache()
    node = {r.doc_id: r.node for r in rows.collect()}
    cell = {r.node: (r.band, r.key) for r in sh.fingerprint_cells(rows).collect()}
    assert cell[node[0]] == cell[node[1]] == cell[node[5]] != cell[node[2]] and node[3] not in cell
    import corpus_pipeline as cp

    used = []
    links = sh.links
    monkeypatch.setattr(sh, "links", lambda *a, **k: used.append(1) or links(*a, **k))
    assert sorted(r.doc_id for r in cp.near_duplicates_stage(spark, make_docs(texts), "").collect()) == [0, 2, 3]
    assert used
