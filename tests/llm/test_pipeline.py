"""The pipeline's stages against their rules on the small tables."""

import itertools
import os
import re

import pytest

import corpus_pipeline as cp
from candlewick.llm import decontamination, mixing, quality
from candlewick.llm.common import table

SF = "/root/testdata/sf0.001"


def smallest_of_near_copies(rows):
    """Every pair's Jaccard similarity, and the components of those alike."""
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {find(i) for i in sets}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = table(spark, SF, "documents").cache()
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    stats = quality.statistics(docs)
    scores = {r.doc_id: r.score for r in quality.score(stats, quality.learn(stats, table(spark, SF, "labels"))).collect()}
    out = [cp.STAGES[0][1](spark, docs, SF).cache()]
    assert {r.doc_id for r in out[0].collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    out.append(cp.STAGES[1][1](spark, out[0], SF).cache())
    # The stage's contract: of each group of texts whose five-word shingles share 0.8 or more, the smallest doc_id stays.
    assert {r.doc_id for r in out[1].collect()} == smallest_of_near_copies(out[0].collect())
    out.append(cp.STAGES[2][1](spark, out[1], SF).cache())
    dirty = {r.doc_id for r in decontamination.find(out[1], table(spark, SF, "benchmark")).collect() if r.hits}
    assert {r.doc_id for r in out[2].collect()} == {r.doc_id for r in out[1].collect()} - dirty
    out.append(cp.STAGES[3][1](spark, out[2], SF).cache())
    assert out[3].count() == sum(r.copies for r in mixing.mix(out[2]).collect())
    for df in out:
        assert df.columns == docs.columns
    assert cp.STAGES[4][1](spark, out[3], SF).count() == out[3].count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_on_odd_texts_and_nothing(spark, make_docs, odd_texts):
    odd = make_docs(odd_texts)
    for docs in (odd, odd.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.collect()
        assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()
