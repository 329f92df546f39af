"""The audit of sources against exact arithmetic over all groups and terms."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from candlewick.llm import source_audit as sa


def brute(rows, least, top=50):
    """rows: (lang, source, text)."""
    count, have, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        count[lang, source].update(terms)
        have[lang].update(set(terms))
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = sorted(t for t, n in have[lang].items() if n >= least)

        def share(counts):
            base = sum(counts[t] for t in kept) + 5 * len(kept)
            return [1 + 10**9 * (counts[t] + 5) // base for t in kept]

        p, all_p = {s: share(count[lang, s]) for s in sources}, share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in sources if o != s)
            terms = sorted((q - a, t) for a, q, t in zip(p[s], all_p, kept) if count[lang, s][t] and a > q)[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found)}
    return out


@pytest.fixture(scope="module")
def sources(spark, prose):
    rows = [("en" if i % 4 else "de", f"src{i * i % 11}", prose(i, 30) + " ÄÖ Été x1y2 don't") for i in range(160)]
    rows += [(None, None, "Alone here"), (None, "é", None), ("xx", "a", None), ("xx", "b", "  "), ("en", None, "BETA beta"), ("en", "src1", "")]
    rows += rows[:20]
    return rows, spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, count int").cache()


@pytest.mark.parametrize("options", [{}, {"block": 7, "tile": 2}, {"block": 40, "tile": 5}])
def test_every_group_pair_and_term(sources, options):
    rows, docs = sources
    found = [tuple(r) for r in sa.audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, sa.LEAST)


def test_few_terms_and_short_lists(sources):
    rows, docs = sources
    assert {tuple(r) for r in sa.audit(docs, least=1, top=3, block=16).collect()} == brute(rows, 1, 3)
    none = brute(rows, 1000)
    assert {tuple(r) for r in sa.audit(docs, least=1000).collect()} == none and all(r[2] == "pair" and r[4] == 0 for r in none)


def test_empty_table(sources):
    assert sa.audit(sources[1].limit(0)).collect() == []


def test_shares_are_exact_for_large_counts():
    counts = np.array([[0, 7 * 10**14, 10**15 + 1]])
    total = int(counts.sum())
    want = [1 + 10**9 * (c + 5) // (total + 15) for c in counts[0].tolist()]
    assert sa.shares(counts, np.array([total]), 3)[0].tolist() == want
