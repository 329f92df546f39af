"""Operators that keep their input's columns keep those of any name."""

import pytest

from candlewick.llm import common, decontamination, media, simhash

NAMES = ["doc_id", "text", "source", "row", "id", "tkey", "hit_id", "hit_text", "kept_id", "kept_text", "__t", "__h", "__id", "__tkey", "hits", "items"]


@pytest.fixture
def odd_columns(spark):
    texts = ["one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten eleven", "plain words", None, ""]
    return spark.createDataFrame([(i, t, "s", *(10 * i + k for k in range(len(NAMES) - 3))) for i, t in enumerate(texts)], ", ".join(f"{n} {'string' if n in ('text', 'source') else 'long'}" for n in NAMES))


def test_decontamination(spark, odd_columns):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    out = decontamination.remove_contaminated(odd_columns, benchmark)
    assert out.columns == NAMES and {r.doc_id: r.hit_id for r in out.collect()} == {i: 10 * i + 3 for i in (2, 3, 4)}


@pytest.mark.parametrize("keep", [simhash.keep_one, simhash.keep_one_copy])
def test_near_duplicates(odd_columns, keep):
    out = keep(odd_columns)
    kept = {r.doc_id: r.kept_id for r in out.collect()}
    assert out.columns == NAMES and kept == {i: 10 * i + 5 for i in kept} and 0 in kept and 1 not in kept and 2 in kept


def test_media(spark):
    rows = spark.createDataFrame([(1, bytearray(media.wav(b"abcd")), "text/plain", 7, 8, 9)], "doc_id long, media binary, declared string, valid long, objects long, found long")
    seen = media.inspect(rows)
    assert sorted(seen.columns) == sorted(["doc_id", "media", "declared", "found", "media_type", "valid", "objects"])
    assert seen.first().valid is True and len(media.carve(seen).collect()) == len(seen.first().objects)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
