"""Zip archives as a data source: members as partitions, the allow-list, odd lines, large members."""

import datetime as dt
import zipfile

import pytest

from candlewick.sources import archives


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(path / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("daily/ES_continuous.txt", "01/02/2024,1,2,0.5,1.5,10,77\n01/03/2024,1.5,3,1,2,20,78\r\n")
        z.writestr("daily/NQ.txt", "01/02/2024,5,6,4,5,1,0\nnonsense\n01/04/2024,5,x,4,nan,2\n01/05/2024,5\n")
        z.writestr("empty.txt", "")
        z.writestr("deep/", "")
    with zipfile.ZipFile(path / "two.zip", "w") as z:
        z.writestr("CL_1min.txt", "".join(f"2024-01-02 {9 + i // 60:02d}:{i % 60:02d}:00,{i},{i},{i},{i},1\n" for i in range(300)))
    with zipfile.ZipFile(path / "three.zip", "w"):
        pass
    (path / "note.txt").write_text("no archive")
    return str(path)


def test_members_are_partitions(spark, folder):
    reader = archives.ZipReader({"path": folder})
    assert [(p.name, p.symbol) for p in reader.partitions()] == [("daily/ES_continuous.txt", "ES"), ("daily/NQ.txt", "NQ"), ("empty.txt", "EMPTY"), ("CL_1min.txt", "CL")]
    df = archives.read(spark, folder)
    assert df.rdd.getNumPartitions() == 4 and df.schema == archives.SCHEMA
    assert {r.symbol: r["count"] for r in df.groupBy("symbol").count().collect()} == {"ES": 2, "NQ": 3, "CL": 300}


def test_rows(spark, folder):
    rows = archives.read(spark, f"{folder}/one.zip").orderBy("symbol", "ts").collect()
    assert tuple(rows[1]) == ("ES", dt.datetime(2024, 1, 3), 1.5, 3.0, 1.0, 2.0, 20.0)
    assert tuple(rows[3]) == ("NQ", dt.datetime(2024, 1, 4), 5.0, None, 4.0, None, 2.0) and tuple(rows[4])[2:] == (5.0, None, None, None, None)
    assert archives.read(spark, f"file://{folder}/one.zip").count() == 5


def test_the_allow_list_opens_no_other_member(spark, folder):
    found = archives.ZipReader({"path": folder, "tickers": '{"NQ": "NASDAQ", "ZZ": "Z"}'})
    assert [p.symbol for p in found.partitions()] == ["NASDAQ"]
    assert {r.symbol for r in archives.read(spark, folder, {"NQ": "NASDAQ"}).collect()} == {"NASDAQ"}
    assert archives.read(spark, folder, {}).collect() == [] and archives.read(spark, f"{folder}/three.zip").collect() == []


def test_filters_reach_the_members(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = archives.read(spark, folder).filter("symbol in ('ES', 'CL') and close > 1.6")
        assert df.rdd.getNumPartitions() == 2 and df.count() == 1 + 298
        assert archives.read(spark, folder).filter("symbol = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_members_are_read_in_batches(folder, monkeypatch):
    monkeypatch.setattr(archives, "BATCH", 64)
    reader = archives.ZipReader({"path": f"{folder}/two.zip"})
    assert [b.num_rows for b in reader.read(reader.partitions()[0])] == [64, 64, 64, 64, 44]


def test_agrees_with_the_whole_archive_reader(spark, folder):
    from candlewick.sources.bars import read_zipped

    plain = read_zipped(spark, f"{folder}/two.zip", daily=False)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, archives.read(spark, f"{folder}/two.zip").collect()))
