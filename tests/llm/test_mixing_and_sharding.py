import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from candlewick.llm import mixing, sharding


def fill(sizes, weights=(5, 2, 1), budget=1.5, cap=2):
    """Targets by handing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= cap * sizes[s] - 1e-9}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix(make_docs, prose):
    r = random.Random(2)
    sources = [r.choice(["a", "a", "a", "B", "c", "Ü", None]) for _ in range(300)]
    texts = [prose(k, r.randrange(1, 60)) for k in range(298)] + [None, ""]
    docs = make_docs(texts, sources=sources)
    rows = mixing.mix(docs, cell_rows=40).collect()
    by = {x.doc_id: x for x in rows}
    sizes = defaultdict(int)
    for i, (t, s) in enumerate(zip(texts, sources)):
        assert by[i].size == len((t or "").split())
        sizes[s] += by[i].size
    target, taken = fill(sizes), defaultdict(int)
    for i, s in enumerate(sources):
        assert by[i].source_size == sizes[s] and abs(by[i].target - target[s]) < 1e-6
        assert by[i].taken in (0, by[i].size, 2 * by[i].size)
        taken[s] += by[i].taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * 60
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(tuple, mixing.mix(docs, cell_rows=7).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    copies = defaultdict(int)
    for x in mixing.mix_documents(docs).collect():
        copies[x.doc_id] += 1
    assert dict(copies) == {i: x.copies for i, x in by.items() if x.copies}


def queue_by_hand(spark, docs, target):
    """Words taken of each document by the queue rule, all in one place: middles of service in order, cut at the budget."""
    import pyspark.sql.functions as F

    rows = docs.select("doc_id", "text", "source", mixing._source().alias("src"), mixing.text_key().alias("tkey"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(17), "doc_id", "tkey", "src")).orderBy("order").collect()
    run, sizes, queue = defaultdict(int), defaultdict(int), []
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    for r in rows:
        n = len((r.text or "").split())
        run[r.source] += n
        for e in range(2):
            if n:
                queue.append(((run[r.source] - n / 2 + sizes[r.source] * e) / target[r.source], r.order, n, r.doc_id))
    taken, left = defaultdict(int), int(1.5 * sum(sizes.values()))
    for _, _, n, i in sorted(queue):
        if n > left:
            break
        left -= n
        taken[i] += n
    return taken, [i for *_, i in sorted(queue)]


def test_taken_words_are_those_of_the_queue(spark, make_docs, prose):
    r = random.Random(8)
    texts = [prose(k, 2000 if k == 5 else r.randrange(1, 90)) for k in range(200)]
    docs = make_docs(texts, sources=[r.choice(["a", "a", "b", "c", None]) for _ in texts])
    rows = mixing.mix(docs, cell_rows=30).collect()
    taken, order = queue_by_hand(spark, docs, {r.src[1:] if r.src != "null" else None: r.target for r in rows})
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: taken[r.doc_id] for r in rows}
    for src in {r.src for r in rows}:
        own = [r for r in rows if r.src == src]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in rows) / 2 + 90
    mixed = [r.doc_id for r in mixing.mix_documents(docs).collect()]
    assert mixed == order[: len(mixed)]


def test_one_id_and_text_in_two_sources(make_docs):
    docs = make_docs(["one two three"] * 2 + ["four five"] * 30, ids=[1, 1, *range(2, 32)], sources=["a", "b", *["a"] * 15, *["b"] * 15])
    rows = mixing.mix(docs).collect()
    wanted = sorted((r.src[1:], r.doc_id) for r in rows for _ in range(r.copies))
    assert sorted((r.source, r.doc_id) for r in mixing.mix_documents(docs).collect()) == wanted


def test_mix_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "row", "id", "from", "nth", "time", "lap", "copies", "tkey", "src", "__id", "order"]
    docs = spark.createDataFrame([(i, "one two", "s", *range(len(names) - 3)) for i in range(9)], names)
    out = mixing.mix_documents(docs)
    assert out.columns == names and out.count() >= 9


def test_mix_of_repeated_rows_and_nothing(make_docs):
    docs = make_docs(["one two"] * 6 + ["three"], ids=[1] * 6 + [None])
    rows = mixing.mix(docs).collect()
    assert len(rows) == 7 and sum(x.taken for x in rows) <= 19
    assert mixing.mix_documents(docs).count() == sum(x.copies for x in rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(x.taken == 0 for x in mixing.mix(make_docs([None, ""])).collect())


def test_differencing():
    r = np.random.default_rng(3)
    for k in (2, 3, 16):
        v = np.zeros((200, k), np.int64)
        v[:, -1] = r.integers(1, 10_000, 200)
        place, totals = sharding.difference(v)
        assert all(sorted(row) == list(range(k)) for row in place.tolist())
        assert totals.sum() == v.sum() and totals.max() - totals.min() < 10_000
        assert totals.tolist() == [int(v[:, -1][place[:, -1] == s].sum()) for s in range(k)]
    assert sharding.difference(np.zeros((0, 4), np.int64))[1].tolist() == [0] * 4
    assert sorted(sharding.difference(np.array([[0, 8], [0, 7], [0, 6], [0, 5], [0, 4]]))[1].tolist()) == [14, 16]


@pytest.mark.parametrize("options", [{}, {"cell_rows": 30, "fan_in": 3}])
def test_shards(make_docs, odd_texts, prose, options):
    texts = [*odd_texts, *[prose(k % 150, 5 + k % 37) for k in range(400)]]
    rows = sharding.shard(make_docs(texts), 8, **options).collect()
    assert len(rows) == len(texts)
    shards, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        text = texts[r.doc_id]
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode())
        shards[text].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_balance(make_docs, prose):
    rows = sharding.shard(make_docs([prose(k, 1 + k % 50) for k in range(2000)]), 16).collect()
    total = defaultdict(int)
    for r in rows:
        total[r.shard] += r.size
    assert len(total) == 16 and max(total.values()) - min(total.values()) < 30
    assert sharding.shard(make_docs(["a"]).limit(0)).count() == 0
