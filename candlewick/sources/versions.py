"""Bar tables with versions: upserts that are all or nothing, once per batch, and a watermark that is kept.

A table is a folder with ``data`` and ``log``. An upsert reads the symbols concerned, writes their
merged rows to a new folder under ``data``, and then adds one small file to ``log``, the
manifest of the next version: which folder holds each symbol. Readers take the
last manifest, so a job killed anywhere before that file leaves the old version whole, and
readers of older versions keep their files. Two writers cannot both make a version: the
second finds the file there, reads the new version and merges again.

The manifest also holds the last batch of each stream, so a repeated batch changes nothing, and
a mark for each source (its last update), which moves with the rows it stands for.

What the driver handles is a line for each symbol, not rows. Null symbols are not
stored: a row without symbol or time belongs to no series. Rows of a batch that share
symbol and time are settled as ``bars.upsert`` does. Columns beyond those of bars are dropped.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bars

TRIES = 20


@dataclass(frozen=True)
class Manifest:
    """One version: folder by symbol, last batch by stream, mark by source. Version 0 is the table that is not there yet."""

    version: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    marks: dict[str, str] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has made the version first."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions whose manifests are there, oldest first."""
    fs, log = _files(spark, f"{root}/log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """A version of the table, the last one unless another is asked for."""
    if version is None:
        version = max(versions(spark, root), default=0)
    if version == 0:
        return Manifest()
    text = "\n".join(r.value for r in spark.read.text(f"{root}/log/{version:020d}.json", wholetext=True).collect())
    return Manifest(**json.loads(text))


def _commit(spark: SparkSession, root: str, made: Manifest) -> None:
    """Write a manifest under a name of its own and rename it to the version's; the rename fails if that is taken."""
    fs, log = _files(spark, f"{root}/log")
    fs.mkdirs(log)
    _, side = _files(spark, f"{root}/log/.{uuid.uuid4().hex}")
    out = fs.create(side, False)
    out.write(bytearray(json.dumps(made.__dict__, sort_keys=True).encode()))
    out.close()
    _, target = _files(spark, f"{root}/log/{made.version:020d}.json")
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(side, target, how)
    except Py4JJavaError as error:
        fs.delete(side, False)
        if fs.exists(target):
            raise Conflict(f"version {made.version} exists") from error
        raise


def read(spark: SparkSession, root: str, symbols: list[str] | None = None, version: int | None = None) -> DataFrame:
    """Bars of some symbols, or all; only the folders of these are listed."""
    now = manifest(spark, root, version)
    folders = [f"{root}/data/{now.parts[s]}" for s in (now.parts if symbols is None else symbols) if s in now.parts]
    return spark.read.schema(bars.SCHEMA).parquet(*sorted(folders)) if folders else spark.createDataFrame([], bars.SCHEMA)


def merge(spark: SparkSession, root: str, new: DataFrame, batch: tuple[str, int] | None = None, marks: dict[str, str] | None = None) -> Manifest:
    """Upsert ``new`` as one version; gives the version that then holds.

    ``batch`` (stream, number): nothing happens if the table has had it. ``marks`` are stored with the rows.
    """
    rows = bars.clean(new).filter("symbol is not null and ts is not null")
    for _ in range(TRIES):
        before = manifest(spark, root)
        if batch and before.batches.get(batch[0], -1) >= batch[1]:
            return before
        changed = sorted(r.symbol for r in rows.select("symbol").distinct().collect())  # a line for each symbol, as in the manifest
        side = uuid.uuid4().hex
        if changed:
            merged = bars.upsert(read(spark, root, changed, before.version), rows)
            # A symbol's years are apart, so that a long series is many tasks.
            dealt = merged.repartition("symbol", F.year("ts")).sortWithinPartitions("symbol", "ts").withColumn("of", F.md5(F.col("symbol").cast("binary")))
            dealt.write.option("compression", "zstd").partitionBy("of").parquet(f"{root}/data/{side}")
        names = {s: r for s, r in spark.createDataFrame([(s,) for s in changed], "s string").select("s", F.md5(F.col("s").cast("binary"))).collect()} if changed else {}
        made = Manifest(
            before.version + 1,
            before.parts | {s: f"{side}/of={name}" for s, name in names.items()},
            before.batches | ({batch[0]: batch[1]} if batch else {}),
            before.marks | (marks or {}),
        )
        try:
            _commit(spark, root, made)
            return made
        except Conflict:
            continue
    raise Conflict(f"no version could be made in {TRIES} tries")


def is_newer(now: Manifest, source: str, remote: str) -> bool:
    """Whether a source's update differs from the one whose rows the table holds."""
    return now.marks.get(source, "").strip() != remote.strip() or source not in now.marks


def update(spark: SparkSession, root: str, source: str, remote: str, fetch) -> bool:
    """Merge ``fetch()`` if ``remote``, the source's update, is new; its mark is stored in the same version."""
    if not is_newer(manifest(spark, root), source, remote):
        return False
    merge(spark, root, fetch(), marks={source: remote})
    return True


def clear(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete manifests but the last ``keep``, and data folders that no remaining one names. Not to be run beside writers."""
    have = versions(spark, root)
    fs, data = _files(spark, f"{root}/data")
    used = {p.split("/")[0] for v in have[-keep:] for p in manifest(spark, root, v).parts.values()}
    gone = 0
    for v in have[:-keep]:
        fs.delete(_files(spark, f"{root}/log/{v:020d}.json")[1], False)
    for s in fs.listStatus(data) if fs.exists(data) else []:
        if s.getPath().getName() not in used:
            fs.delete(s.getPath(), True)
            gone += 1
    return gone


class Scans:
    """Tables kept in memory between queries, by version: an upsert makes the next query read again, nothing else does."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kept: dict[tuple, tuple[int, DataFrame]] = {}

    def read(self, root: str, symbols: list[str] | None = None) -> DataFrame:
        key, now = (root, None if symbols is None else tuple(sorted(symbols))), max(versions(self.spark, root), default=0)
        version, df = self.kept.get(key, (None, None))
        if version != now:
            if df is not None:
                df.unpersist()
            df = read(self.spark, root, symbols, now).persist()
            self.kept[key] = (now, df)
        return df

    def read_folder(self, path: str) -> DataFrame:
        """A plain Parquet folder, by the newest change of its files; Spark's own list of them is read anew when it changes."""
        fs, where = _files(self.spark, path)
        seen, files = [], fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getModificationTime(), f.getLen()))
        now = hash(tuple(sorted(seen)))
        version, df = self.kept.get((path,), (None, None))
        if version != now:
            if df is not None:
                df.unpersist()
                self.spark.catalog.refreshByPath(path)
            df = self.spark.read.parquet(path).persist()
            self.kept[(path,)] = (now, df)
        return df

    def clear(self) -> None:
        for _, df in self.kept.values():
            df.unpersist()
        self.kept.clear()
