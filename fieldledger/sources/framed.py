"""Delimited files whose header must be found: titles and metadata above it, the header repeated as last row, byte-order mark.

A Python data source. While partitions are planned, a bounded stretch at the start of each file is searched for the line
whose fields are the header, and one at its end for a trailer that repeats it. What lies between is cut into ranges of bytes;
a task reads the lines that begin in its range. So nothing is guessed from the contents of data rows, and one large
file is read by many tasks. Fields are strings; a quoted field may hold the delimiter but no line break.

Files are opened by ``pyarrow``, in any store it knows, from a path every executor can reach.
"""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes searched at either end of a file, bytes of a range, bytes of lines turned into a batch.
EDGE, RANGE, BATCH = 1 << 16, 64 << 20, 1 << 20


def locate(path: str):
    """The store a path lies in and its name there."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_file(path: str):
    """A seekable file and its size."""
    store, name = locate(path)
    return store.open_input_file(name), store.get_file_info(name).size


def fields(lines: list[str]) -> list[list[str]]:
    return list(csv.reader(lines))


def is_header(line: bytes, header: list[str]) -> bool:
    text = line.decode("utf-8", "replace").removeprefix("\ufeff").strip("\r\n")
    return bool(text.strip()) and [f.strip() for f in fields([text])[0]] == header


def data_bounds(path: str, header: list[str], trailer: list[str] | None) -> tuple[int, int]:
    """Where the lines after the header begin and where the last data line ends."""
    file, size = open_file(path)
    with file:
        head = file.read(EDGE)
        at = 0
        for line in head.splitlines(keepends=True):
            at += len(line)
            if is_header(line, header):
                break
        else:
            raise ValueError(f"no line with the fields {header} in the first {EDGE} bytes of {path}")
        if trailer is None or size <= at:
            return at, size
        file.seek(max(at, size - EDGE))
        tail = file.read(EDGE)
    lines = tail.splitlines(keepends=True)
    end = size
    while lines:
        last = lines.pop()
        if last.strip():
            return at, end - len(last) if is_header(last, trailer) else size
        end -= len(last)
    return at, size


@dataclass
class Range(InputPartition):
    path: str
    first: int
    start: int
    stop: int
    end: int


class FramedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.header, self.trailer = (json.loads(options[k]) for k in ("paths", "header", "trailer"))
        self.names, self.size = json.loads(options["names"]), int(options["range"])

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            first, end = data_bounds(path, self.header, self.trailer)
            out += [Range(path, first, a, min(end, a + self.size), end) for a in range(first, end, self.size)]
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        file, _ = open_file(part.path)
        schema = pa.schema([(n, pa.string()) for n in [*self.names, "file"]])
        with file:
            # a line that begins before the range is another task's
            at = max(part.first, part.start - 1)
            file.seek(at)
            stream = io.BufferedReader(file, 1 << 20)
            if part.start > part.first:
                at += len(stream.readline())
            while at < part.stop:
                lines, size = [], 0
                while at < part.stop and size < BATCH:
                    line = stream.readline()
                    if not line:
                        at = part.stop
                        break
                    at, size = at + len(line), size + len(line)
                    if line.strip():
                        lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                rows = [r[: len(self.names)] + [""] * (len(self.names) - len(r)) for r in fields(lines)]
                columns = [[v or None for v in c] for c in zip(*rows, strict=True)] or [[] for _ in self.names]
                columns.append([part.path] * len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)


class FramedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n in [*json.loads(self.options["names"]), "file"])

    def reader(self, schema) -> FramedReader:
        return FramedReader(dict(self.options))


def read_framed(
    spark: SparkSession, paths: list[str], header: list[str], names: list[str] | None = None, trailer: list[str] | None = None, range_bytes: int = RANGE
) -> DataFrame:
    """Strings ``names`` (the header unless given) and ``file``, the path each row came from.

    ``header`` is what the fields of the header line are; a file without such a line is an error. ``trailer`` is what
    the fields of a repeated header are, to be left out where it is the last line. Empty fields are NULL, short rows are
    filled up with NULL, surplus fields are left out; blank lines are no rows. No file gives no rows.
    """
    # the class travels to the executors by value, so they need not have this package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FramedSource)
    given = {"paths": paths, "header": header, "names": names or header, "trailer": trailer}
    return spark.read.format("framed").options(**{k: json.dumps(v) for k, v in given.items()}, range=str(range_bytes)).load()


def write_lines(lines: DataFrame, folder: str, order: list[str], line: str = "line", file: str | None = None) -> list[str]:
    """Write lines as one text file, or one per value of ``file``, in the given order, and return the paths.

    For reports of bounded size: a file is one task's work.
    """
    spark = lines.sparkSession
    if file is None:
        lines.coalesce(1).sortWithinPartitions(*order).select(line).write.text(folder)
    else:
        lines.repartition(file).sortWithinPartitions(file, *order).select(line, file).write.partitionBy(file).text(folder)
    found = spark.read.text(folder, recursiveFileLookup=True).select("_metadata.file_path").distinct()
    return sorted(r.file_path for r in found.collect())
