"""Indexed archives as a Spark data source: entries by name, without reading the rest.

An archive is a data file of entries that each end in a NUL, and an index file of lines
name, offset, length. Tasks share out the index, not the data: each reads its range of the
index's lines, keeps the names asked for, and fetches just those entries' bytes. Filters on
name that Spark pushes down are answered there.
"""

from __future__ import annotations

import glob
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

SCHEMA = "name string, offset long, length long, text string, archive string"
_ARROW = pa.schema([("name", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("text", pa.string()), ("archive", pa.string())])
#: Bytes of an index that one task reads, and of entries that one batch holds, about.
INDEX_BYTES, BATCH_BYTES = 8 << 20, 4 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path is in: a URI's own, or local files, which all executors must then share."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def index_files(path: str) -> list[str]:
    """Comma-separated paths; local ones may hold wildcards."""
    return [name for part in path.split(",") for name in (sorted(glob.glob(part)) if "*" in part and "://" not in part else [part])]


def data_file(index: str) -> str:
    stem = index.removesuffix(".ffindex")
    if stem == index:
        raise ValueError(f"an index ends in .ffindex, unlike {index!r}")
    return f"{stem}.ffdata"


@dataclass
class IndexRange(InputPartition):
    """The index lines that begin in [start, end)."""

    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def index_lines(file, start: int, end: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The lines that begin in [start, end), each without its line feed."""
    size = file.size()
    at = max(start - 1, 0)  # a line begins after a line feed, so look one byte back
    rest, begin = b"", at
    skip = start > 0
    while begin < end:
        cut = rest.find(b"\n")
        if cut < 0:
            more = file.read_at(min(step, size - at), at) if at < size else b""
            at += len(more)
            if more:
                rest += more
                continue
            if rest and not skip:
                yield rest
            return
        if not skip:
            yield rest[:cut]
        skip = False
        begin, rest = begin + cut + 1, rest[cut + 1 :]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.names = index_files(options["path"]), None
        self.step = int(options.get("index_bytes", INDEX_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's own name
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("name",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif f != IsNotNull(("name",)):  # names are never null
                yield f

    def partitions(self) -> list[InputPartition]:
        ranges = []
        for path in self.paths:
            store, name = file_system(path)
            size = store.get_file_info(name).size
            if size is None:
                raise FileNotFoundError(path)
            ranges += [IndexRange(path, at, min(size, at + self.step)) for at in range(0, size, self.step)]
        return ranges

    def read(self, partition: IndexRange) -> Iterator[pa.RecordBatch]:
        store, name = file_system(partition.path)
        wanted = []
        with store.open_input_file(name) as index:
            for line in index_lines(index, partition.start, partition.end):
                entry, offset, length = line.decode().split("\t")
                if self.names is None or entry in self.names:
                    wanted.append((int(offset), int(length), entry))
        if not wanted:
            return
        store, name = file_system(data_file(partition.path))
        with store.open_input_file(name) as data:
            rows, held = [], 0
            for offset, length, entry in sorted(wanted):
                text = data.read_at(max(length - 1, 0), offset)  # without its NUL
                rows.append((entry, offset, length, text.decode("utf-8", "replace"), partition.path))
                held += length
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ArchiveSource(DataSource):
    """spark.read.format("indexed_archive").load("a.ffindex,b.ffindex")"""

    @classmethod
    def name(cls) -> str:
        return "indexed_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(name, offset, length, text, archive) of the entries of those names, or of all.

    path is one index, several with commas between, or a pattern of local ones; each has its
    data file beside it. An entry's text lacks its closing NUL; bytes that aren't UTF-8
    become the replacement character. Names that no index has give no rows, an index
    without lines none either, and a name that is there several times each of its entries.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    entries = spark.read.format(ArchiveSource.name()).load(path)
    return entries if names is None else entries.filter(entries["name"].isin(names))
