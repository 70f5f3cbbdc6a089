"""Where a schedule's raw tables come from: folders, archives, or whatever implements Feed."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType


@runtime_checkable
class Feed(Protocol):
    """Gives raw tables by name: all columns as text, named as in the table's header; None for a table that isn't there."""

    def table(self, spark: SparkSession, name: str) -> DataFrame | None: ...


@dataclass(frozen=True)
class FolderFeed:
    """CSV files <name>.txt in a folder that Spark can read."""

    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame | None:
        path = f"{self.path}/{name}.txt"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding="UTF-8")


@dataclass(frozen=True)
class ArchiveFeed:
    """CSV entries <name>.txt at the root of a zip file, at a path or address that executors can open.

    An entry is streamed out of the archive by the one task that reads it, a
    batch of lines at a time; neither archive nor entry is held in memory or
    unpacked, and its size doesn't matter. Entries in folders, or leading out
    of the archive, are never looked at.
    """

    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame | None:
        spark.dataSource.register(ArchiveTable)
        read = spark.read.format(ArchiveTable.name()).option("table", name)
        with _archive(self.path) as packed:
            if f"{name}.txt" not in packed.namelist():
                return None
        return read.load(self.path)


@dataclass(frozen=True)
class TablesFeed:
    """Tables that a function makes of a session and a name."""

    make: Callable[[SparkSession, str], DataFrame | None]

    def table(self, spark: SparkSession, name: str) -> DataFrame | None:
        return self.make(spark, name)


def feed_of(source: str | Feed) -> Feed:
    """A folder's or archive's feed for a path; what is a feed already stays one."""
    if isinstance(source, str):
        return ArchiveFeed(source) if source.endswith(".zip") else FolderFeed(source)
    return source


@contextmanager
def _archive(path: str) -> Iterator[zipfile.ZipFile]:
    """The zip file at a path or address. Only its directory and the entries asked for are read."""
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    with system.open_input_file(inner) as file, zipfile.ZipFile(file) as packed:
        yield packed


@contextmanager
def _lines(path: str, table: str) -> Iterator[Iterator[list[str]]]:
    with _archive(path) as packed, packed.open(f"{table}.txt") as entry:
        yield csv.reader(io.TextIOWrapper(entry, encoding="utf-8-sig", newline=""))


@dataclass
class EntryPartition(InputPartition):
    """An entry of an archive."""

    path: str
    table: str

    def __post_init__(self) -> None:
        super().__init__(self.table)


class ArchiveTable(DataSource):
    """Tables of a zip file: option table, or several, comma-separated, of equal columns; a partition for each."""

    @classmethod
    def name(cls) -> str:
        return "schedule_archive"

    def _entries(self) -> list[EntryPartition]:
        return [EntryPartition(self.options["path"], t.strip()) for t in self.options["table"].split(",")]

    def schema(self) -> StructType:
        first = self._entries()[0]
        with _lines(first.path, first.table) as lines:
            header = next(lines, [])
        return StructType([StructField(c.strip(), StringType()) for c in header])

    def reader(self, schema: StructType) -> ArchiveTableReader:
        return ArchiveTableReader(self._entries(), len(schema.fields))


class ArchiveTableReader(DataSourceReader):
    """Streams the lines of each entry. Short lines are filled with nulls, surplus fields dropped, as blank ones are null."""

    def __init__(self, entries: list[EntryPartition], width: int):
        self._entries, self._width = entries, width

    def partitions(self) -> list[EntryPartition]:
        return self._entries

    def read(self, partition: EntryPartition) -> Iterator[tuple]:
        with _lines(partition.path, partition.table) as lines:
            next(lines, None)
            for line in lines:
                if line:
                    cells = [c.strip() or None for c in line[: self._width]]
                    yield tuple(cells + [None] * (self._width - len(cells)))
