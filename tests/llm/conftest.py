import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, fp string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été Über señor".split()


@pytest.fixture(scope="session")
def prose():
    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names operators use inside."""

    def make(texts, ids=None, sources=None):
        ids = ids if ids is not None else range(len(texts))
        sources = sources or [f"s{i % 3}" for i in range(len(texts))]
        rows = [(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in zip(ids, texts, sources)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts(prose):
    """Null, empty, blank, one word, repeated rows, a very long text, characters outside ASCII."""
    long = prose(1, 30000)
    return [None, "", "   ", "one", prose(2, 80), prose(2, 80), long, "ÀÉ " * 300, prose(3, 40) + "\n" + prose(4, 60), None]
