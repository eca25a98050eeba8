"""Exports as they are downloaded: zip archives, folders and single files of JSON arrays, read in tasks.

A Python data source gives Spark a partition for each file or archive member, so an archive of many files is read by as many tasks,
none of it by the driver but the lists of names. Members are decoded piece by piece: a task holds some thousand rows, not a file.
Paths are whatever pyarrow's file systems open: local ones, and those of shared stores by their scheme.
"""

from __future__ import annotations

import fnmatch
import io
import json
import posixpath
import zipfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from playlore.sources.ingest import EXPORT, staged

NAME, PATTERN = "play_export", "Streaming_History_Audio_*.json"
#: Characters that are decoded at once, and rows that are sent at once.
PIECE, ROWS = 1 << 20, 4_000
KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
FIELDS = [tuple(f.split()) for f in f"{EXPORT}, source_file string".split(", ")]
SCHEMA = pa.schema([(name, KINDS[kind]) for name, kind in FIELDS])


class Piece(InputPartition):
    """A file, or a member of an archive."""

    def __init__(self, path: str, member: str | None):
        self.path, self.member = path, member


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def objects(text: io.TextIOBase, name: str) -> Iterator[Any]:
    """The elements of a JSON array, decoded as they are read. An empty text has none."""
    decoder, held, begun, ended = json.JSONDecoder(), "", False, False
    while not ended:
        more = text.read(PIECE)
        held += more
        at = 0
        while True:
            while at < len(held) and (held[at].isspace() or held[at] in ",\ufeff" or (held[at] == "[" and not begun)):
                begun = begun or held[at] == "["
                at += 1
            if at == len(held):
                break
            if held[at] == "]":
                return
            if not begun:
                raise ValueError(f"{name}: not a JSON array")
            try:
                value, at_next = decoder.raw_decode(held, at)
            except json.JSONDecodeError as e:
                if not more:
                    raise ValueError(f"{name}: the array breaks off or is not JSON: {e.msg}") from e
                break
            if more and (at_next == len(held) or held[at_next] not in ",] \t\r\n"):
                break  # a number that the next piece may go on with
            yield value
            at = at_next
        held, ended = held[at:], not more
    if begun:
        raise ValueError(f"{name}: the array breaks off")


def _cell(value: Any, kind: str) -> Any:
    """A value as its column holds it; null where it is of another kind."""
    if kind == "string":
        return value if value is None or isinstance(value, str) else json.dumps(value)
    if kind == "boolean":
        return value if isinstance(value, bool) else None
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None


def _batches(text: io.TextIOBase, name: str) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    for x in objects(text, name):
        if isinstance(x, dict):
            rows.append((*(_cell(x.get(f), kind) for f, kind in FIELDS[:-1]), name))
        if len(rows) == ROWS:
            yield batch()
            rows = []
    if rows:
        yield batch()


class ExportReader(DataSourceReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[InputPartition]:
        files, where = _opened(self.path)
        info = files.get_file_info(where)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(where, recursive=True))
        root = self.path[: len(self.path) - len(where)] if self.path.endswith(where) else ""
        out: list[InputPartition] = []
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            path = f"{root}{f.path}" if "://" in self.path else f.path
            if f.path.lower().endswith(".zip"):
                with files.open_input_file(f.path) as handle, zipfile.ZipFile(handle) as z:
                    out += [Piece(path, m) for m in sorted(z.namelist()) if self._wanted(m)]
            elif self._wanted(f.path) or (info.type == fs.FileType.File and f.path.endswith(".json")):
                out.append(Piece(path, None))
        return out or [Piece("", None)]

    def _wanted(self, name: str) -> bool:
        return fnmatch.fnmatch(posixpath.basename(name), self.pattern)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, where = _opened(partition.path)
        with files.open_input_file(where) as handle:
            if partition.member is None:
                yield from _batches(io.TextIOWrapper(handle, "utf-8"), posixpath.basename(where))
            else:
                with zipfile.ZipFile(handle) as z, z.open(partition.member) as member:
                    yield from _batches(io.TextIOWrapper(member, "utf-8"), posixpath.basename(partition.member))


class ExportSource(DataSource):
    """Format "play_export", with the options path and pattern."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"{EXPORT}, source_file string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ExportReader(self.options["path"], self.options.get("pattern", PATTERN))


def read_archive(spark: SparkSession, path: str, owner: str, pattern: str = PATTERN) -> DataFrame:
    """The staged rows of a zip, a folder (with zips in it or not) or one file (S1, S2), as read_export gives those of a folder."""
    spark.dataSource.register(ExportSource)
    return staged(spark.read.format(NAME).option("pattern", pattern).load(path), owner)
