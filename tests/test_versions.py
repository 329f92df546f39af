"""Versioned tables: killed and repeated jobs, writers that meet, marks, and the cache of scans."""

import datetime as dt
import glob
import shutil

import pytest
from pyspark.sql import functions as F

from candlewick.sources import bars as src
from candlewick.sources import versions as vs
from candlewick.sources.bars import SCHEMA


def some(spark, symbol, values, day=1):
    return spark.createDataFrame([(symbol, dt.datetime(2023, 12, 28 + day) + dt.timedelta(days=i), *[float(v)] * 5) for i, v in enumerate(values)], SCHEMA)


def closes(df):
    return sorted((r.symbol, r.ts.day, r.close) for r in df.collect())


@pytest.fixture
def root(tmp_path):
    return f"{tmp_path}/table"


def test_versions_and_symbols(spark, root):
    assert vs.read(spark, root).collect() == [] and vs.manifest(spark, root) == vs.Manifest()
    vs.merge(spark, root, some(spark, "A", [1, 2]).union(some(spark, "b c/d", [5])))
    one = vs.manifest(spark, root)
    vs.merge(spark, root, some(spark, "A", [9], 2).union(some(spark, "N", [3])))
    assert closes(vs.read(spark, root)) == [("A", 29, 1.0), ("A", 30, 9.0), ("N", 29, 3.0), ("b c/d", 29, 5.0)]
    assert closes(vs.read(spark, root, version=1)) == [("A", 29, 1.0), ("A", 30, 2.0), ("b c/d", 29, 5.0)]
    assert vs.manifest(spark, root).parts["b c/d"] == one.parts["b c/d"]  # not written again
    assert closes(vs.read(spark, root, ["N", "nothing"])) == [("N", 29, 3.0)]
    assert vs.clear(spark, root, 1) == 0 and vs.versions(spark, root) == [2] and len(closes(vs.read(spark, root))) == 4


def test_a_job_killed_before_the_switch_leaves_the_old_version(spark, root, monkeypatch):
    vs.merge(spark, root, some(spark, "A", [1]))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(vs, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        vs.merge(spark, root, some(spark, "A", [7]))
    monkeypatch.undo()
    assert len(glob.glob(f"{root}/data/*")) == 2 and closes(vs.read(spark, root)) == [("A", 29, 1.0)]
    vs.merge(spark, root, some(spark, "A", [8]))
    assert closes(vs.read(spark, root)) == [("A", 29, 8.0)] and vs.clear(spark, root, 1) == 2


def test_a_repeated_batch_changes_nothing(spark, root):
    vs.merge(spark, root, some(spark, "A", [1]), ("s", 0))
    again = vs.merge(spark, root, some(spark, "A", [2]), ("s", 0))
    assert again.version == 1 and closes(vs.read(spark, root)) == [("A", 29, 1.0)]
    assert vs.merge(spark, root, some(spark, "A", [3]), ("other", 0)).version == 2
    assert vs.merge(spark, root, some(spark, "A", [4]), ("s", 1)).batches == {"s": 1, "other": 0}


def test_two_writers_of_one_version(spark, root, monkeypatch):
    vs.merge(spark, root, some(spark, "A", [1]))
    commit, first = vs._commit, []

    def late(spark_, root_, made):
        if not first:
            first.append(True)
            monkeypatch.setattr(vs, "_commit", commit)
            vs.merge(spark, root, some(spark, "A", [5], 2))
        commit(spark_, root_, made)

    monkeypatch.setattr(vs, "_commit", late)
    assert vs.merge(spark, root, some(spark, "A", [6], 3)).version == 3
    assert closes(vs.read(spark, root)) == [("A", 29, 1.0), ("A", 30, 5.0), ("A", 31, 6.0)]


def test_marks_move_with_their_rows(spark, root):
    asked = []

    def fetch():
        asked.append(1)
        return some(spark, "A", [len(asked)])

    assert vs.update(spark, root, "daily", "Mon 1", fetch) and not vs.update(spark, root, "daily", " Mon 1 ", fetch) and vs.update(spark, root, "daily", "Tue 2", fetch)
    assert len(asked) == 2 and vs.manifest(spark, root).marks == {"daily": "Tue 2"} and closes(vs.read(spark, root)) == [("A", 29, 2.0)]


def test_rows_without_symbol_or_time_and_empty_batches(spark, root):
    odd = spark.createDataFrame([(None, dt.datetime(2024, 1, 1), *[1.0] * 5), ("A", None, *[1.0] * 5)], SCHEMA)
    assert vs.merge(spark, root, odd, ("s", 0)).parts == {} and vs.read(spark, root).collect() == []


def test_streamed_files_go_in_once(spark, root, tmp_path):
    from candlewick.streaming.bars import follow_versions

    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    some(spark, "A", [1, 2]).write.parquet(folder)
    follow_versions(spark, folder, root, state)
    some(spark, "A", [7], 2).write.mode("append").parquet(folder)
    follow_versions(spark, folder, root, state)
    follow_versions(spark, folder, root, state)
    assert closes(vs.read(spark, root)) == [("A", 29, 1.0), ("A", 30, 7.0)] and vs.manifest(spark, root).version == 2
    # The stream's own memory is lost: the table still knows the batches.
    shutil.rmtree(state)
    follow_versions(spark, folder, root, state)
    assert closes(vs.read(spark, root)) == [("A", 29, 1.0), ("A", 30, 7.0)]


def test_scans_are_kept_until_the_table_changes(spark, root, tmp_path):
    scans = vs.Scans(spark)
    vs.merge(spark, root, some(spark, "A", [1, 2]))
    df = scans.read(root)
    assert df.count() == 2
    for f in glob.glob(f"{root}/data/*/*/*.parquet"):
        shutil.move(f, f + ".away")  # a second scan would fail
    assert scans.read(root) is df and scans.read(root).agg(F.sum("close")).collect()[0][0] == 3.0
    for f in glob.glob(f"{root}/data/*/*/*.away"):
        shutil.move(f, f[:-5])
    vs.merge(spark, root, some(spark, "B", [5]))
    assert scans.read(root) is not df and scans.read(root).count() == 3 and not df.storageLevel.useMemory
    folder = f"{tmp_path}/plain"
    some(spark, "A", [1]).write.parquet(folder)
    plain = scans.read_folder(folder)
    assert plain.count() == 1 and scans.read_folder(folder) is plain
    some(spark, "A", [2, 3]).write.mode("append").parquet(folder)
    assert scans.read_folder(folder).count() == 3
    scans.clear()
    assert not scans.kept


def test_upsert_agrees_with_the_plain_one(spark, root):
    old, new = some(spark, "A", [1, 2, 3]), some(spark, "A", [8, 9], 3)
    vs.merge(spark, root, old)
    vs.merge(spark, root, new)
    assert closes(vs.read(spark, root)) == closes(src.upsert(old, new))
