"""Bars in zip archives of text files, as a Spark data source whose partitions are the archives' members.

``spark.read.format("bars_zip")`` after ``register(spark)``. An archive's directory is read while
planning; each task then opens the archive at its own member and reads that as a stream, so an archive
of any size is as many tasks as it has members and never a row. Members are files without a header: date,
open, high, low, close, volume (daily, MM/dd/yyyy), or the same with date and time (yyyy-MM-dd HH:mm:ss).
The ticker is the start of the member's name, up to a dot or an underscore.

Options: ``path`` (one archive, or a folder of them; any store that Arrow's file systems
know, or a local path), ``tickers`` (JSON: ticker -> symbol), which is also the allow-list: other members are
not opened. Filters on ``symbol`` reach the members as well where the session lets
Python sources have them (``spark.sql.python.filterPushdown.enabled``).

Lines that are no bars (too few fields, no number where one should be) give nulls in those places, and a line
without a time that can be read is left out. Empty members and archives give no rows; a member is read in
batches of BATCH lines.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .bars import SCHEMA

BATCH = 50_000
FORMATS = ("%m/%d/%Y", "%Y-%m-%d %H:%M:%S")
ARROW = pa.schema([("symbol", pa.string()), ("ts", pa.timestamp("us")), *[(c, pa.float64()) for c in ("open", "high", "low", "close", "volume")]])


@dataclass
class Member(InputPartition):
    archive: str
    name: str
    symbol: str


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


class _Bytes(io.RawIOBase):
    """An Arrow file as Python's zip reader wants it: a place before its start is an OSError."""

    def __init__(self, path: str):
        store, at = _store(path)
        self.raw = store.open_input_file(at)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.raw.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        to = offset + (0, self.raw.tell(), self.raw.size())[whence]
        if to < 0:
            raise OSError("a place before the start of the file")
        return self.raw.seek(to)

    def readinto(self, buffer) -> int:
        data = self.raw.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.raw.close()
        super().close()


def _open(path: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(_Bytes(path), 1 << 20))


def _archives(path: str) -> list[str]:
    from pyarrow import fs

    store, at = _store(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=False))
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))


def _number(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return value if value == value else None


def _time(text: str) -> dt.datetime | None:
    for form in FORMATS:
        try:
            return dt.datetime.strptime(text.strip(), form)
        except ValueError:
            continue
    return None


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.path = options["path"]
        self.names: dict[str, str] | None = json.loads(options["tickers"]) if options.get("tickers") else None
        self.symbols: set[str] | None = None

    def partitions(self) -> list[Member]:
        found = []
        for archive in _archives(self.path):
            with _open(archive) as z:
                for info in z.infolist():
                    ticker = info.filename.rsplit("/", 1)[-1].split(".")[0].split("_")[0]
                    symbol = ticker.upper() if self.names is None else self.names.get(ticker)
                    if not info.is_dir() and ticker and symbol is not None and (self.symbols is None or symbol in self.symbols):
                        found.append(Member(archive, info.filename, symbol))
        return found

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty list of partitions is read as one without a member
            return
        with _open(partition.archive) as z, z.open(partition.name) as lines:
            rows: list[tuple] = []
            for line in lines:
                fields = line.decode("utf-8", "replace").rstrip("\r\n").split(",")
                at_time = _time(fields[0])
                if at_time is not None:
                    rows.append((at_time, *(_number(fields[i]) if i < len(fields) else None for i in range(1, 6))))
                if len(rows) >= BATCH:
                    yield self._batch(partition.symbol, rows)
                    rows = []
            if rows:
                yield self._batch(partition.symbol, rows)

    @staticmethod
    def _batch(symbol: str, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array([symbol] * len(rows)), pa.array(columns[0], pa.timestamp("us")), *[pa.array(c, pa.float64()) for c in columns[1:]]], schema=ARROW)


class FilteredZipReader(ZipReader):
    """For sessions that hand filters to Python sources; Spark refuses this reader in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("symbol",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("symbol",):
                wanted = set(f.value)
            else:
                yield f  # left to Spark
                continue
            self.symbols = wanted if self.symbols is None else self.symbols & wanted


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bars_zip"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return (FilteredZipReader if self.options.get("filters") == "true" else ZipReader)(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipSource)


def read(spark: SparkSession, path: str, tickers: dict[str, str] | None = None) -> DataFrame:
    """Bars of all archives at ``path``; ``tickers`` names the members wanted and their symbols."""
    register(spark)
    reader = spark.read.format("bars_zip").option("path", path).option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("tickers", json.dumps(tickers)) if tickers is not None else reader).load()
