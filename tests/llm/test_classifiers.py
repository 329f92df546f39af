import random
import zlib

import numpy as np
import pytest

from candlewick.llm import quality, toxicity


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark, make_docs, prose):
    texts, bad, toxic = [], [], []
    r = random.Random(4)
    for i in range(400):
        words = prose(100 + i, r.randrange(30, 200)).split()
        bad.append(i % 4 == 0)
        toxic.append(i % 5 == 1)
        if bad[-1]:
            words = [w + "###" for w in words] if i % 8 else [words[0]] * len(words)
        if toxic[-1]:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["vilenoun", "nastyword", "vileverb"]))
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(i, int(not b), int(t)) for i, (b, t) in enumerate(zip(bad, toxic))], "doc_id long, quality int, toxic int")
    return make_docs(texts), labels, bad, toxic


def test_quality_on_held_out(labelled):
    docs, labels, bad, _ = labelled
    model = quality.learn(quality.statistics(docs), labels)
    scores = {r.doc_id: r.score for r in quality.score(quality.statistics(docs), model).collect()}
    test = [i for i in scores if is_held_out(i)]
    assert np.mean([(scores[i] >= 0.3) != bad[i] for i in test]) > 0.97
    kept = {r.doc_id for r in quality.keep(docs, model).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.3}


def test_toxicity_on_held_out(labelled):
    docs, labels, _, toxic = labelled
    model = toxicity.learn(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    test = [i for i in scores if is_held_out(i)]
    assert np.mean([(scores[i] >= 0.5) == toxic[i] for i in test]) > 0.95


def test_nothing_is_learned_from_held_out_rows(labelled):
    docs, labels, _, _ = labelled
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    stats = quality.statistics(docs)
    a, b = (quality.learn(stats, x) for x in (labels, flipped))
    np.testing.assert_allclose(a.mean, b.mean)
    a, b = (toxicity.learn(docs, x) for x in (labels, flipped))
    assert a.bags == b.bags and (a.weights == b.weights).all()


def test_toxicity_query_on_given_labels(spark):
    """Held-out documents of the given tables: few are called toxic wrongly, and toxic ones rank above the others."""
    from candlewick.llm.queries import queries

    path = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries()["op5_toxicity"](spark, path).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    test = [rows[i] for i in labels if is_held_out(i)]
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    toxic, ordinary = ([r for r in test if labels[r.doc_id] == y] for y in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert sum(r.predicted for r in ordinary) <= 0.02 * len(ordinary)
    assert np.mean([[a.score > b.score for b in ordinary] for a in toxic]) > 0.9


def test_odd_texts_and_tables(spark, make_docs, odd_texts, labelled):
    docs, labels, _, _ = labelled
    odd = make_docs(odd_texts)
    model = quality.learn(quality.statistics(docs), labels)
    rows = quality.score(quality.statistics(odd), model).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    rows = toxicity.score(odd, toxicity.learn(docs, labels)).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert [r.score for r in quality.score(quality.statistics(odd.limit(1)), quality.learn(quality.statistics(docs), none)).collect()] == [0.5]
    assert [r.score for r in toxicity.score(odd.limit(1), toxicity.learn(docs, none)).collect()] == [0.0]
    assert quality.score(quality.statistics(odd.limit(0)), model).count() == 0


def test_windows_met_together_have_the_distances_of_windows_met_alone(odd_texts):
    words = [[b"%s%07d" % (kind, i * 7919 % 9999991) for i in range(300)] for kind in (b"plain", b"rough")]
    bags = [toxicity._bags(words, seed) for seed in (1, 2)]
    texts = [*odd_texts, *(" ".join(w.decode() for w in words[1][k : k + 40]) for k in (0, 20, 250)), words[0][5].decode(), None]
    together = toxicity.Model(bags).measure()(texts)
    assert together == [toxicity.Model(bags).measure()([t])[0] for t in texts]
    assert together[len(odd_texts)][0] > 0
