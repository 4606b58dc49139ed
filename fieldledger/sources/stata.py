"""Stata files of the formats 113 to 115, read in ranges of rows with value labels turned into text.

A Python data source. Rows have a fixed width, so a task finds its range by arithmetic and reads nothing else but the
descriptions at the start and, if it needs them, the labels at the end. Only the wanted columns become Spark columns.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldledger.sources import framed
from fieldledger.sources.framed import open_file

# Fixed values of the format: kinds of numbers by code with the greatest value that is not missing, and widths of the descriptions.
NUMBERS = {251: ("i1", 100), 252: ("i2", 32740), 253: ("i4", 2147483620), 254: ("f4", 1.701e38), 255: ("f8", 8.988e307)}
FORMAT_WIDTH = {113: 12, 114: 49, 115: 49}
HEAD, NAME, LABEL = 109, 33, 81
#: Bytes of rows of a range, and of rows turned into a batch.
RANGE, BATCH = 64 << 20, 1 << 20


@dataclass
class Layout:
    """What a file says of itself: names, numpy kinds, greatest values, names of value labels; where its rows lie."""

    names: list[str]
    kinds: list[str]
    most: list[float | None]
    label_sets: list[str]
    order: str
    start: int
    width: int
    rows: int

    def label_of(self, name: str) -> str:
        return self.label_sets[self.names.index(name)]

    def spark_type(self, name: str) -> str:
        kind = self.kinds[self.names.index(name)]
        return "string" if kind[0] == "S" or self.label_of(name) else "int" if kind[0] == "i" else "double"


def text(raw: bytes, encoding: str) -> str:
    return raw.split(b"\0", 1)[0].decode(encoding, "replace")


def read_layout(file, encoding: str) -> Layout:
    head = file.read(HEAD)
    if len(head) < HEAD or head[0] not in FORMAT_WIDTH or head[1] not in (1, 2):
        raise ValueError("not a Stata file of the formats 113 to 115")
    order = ">" if head[1] == 1 else "<"
    whole = "big" if head[1] == 1 else "little"
    n, rows = int.from_bytes(head[4:6], whole), int.from_bytes(head[6:10], whole)
    codes = file.read(n)
    names = [text(file.read(NAME), encoding) for _ in range(n)]
    file.read(2 * (n + 1) + FORMAT_WIDTH[head[0]] * n)
    label_sets = [text(file.read(NAME), encoding) for _ in range(n)]
    file.read(LABEL * n)
    while (edge := file.read(5)) and edge[0]:
        file.read(int.from_bytes(edge[1:], whole))
    kinds = [order + NUMBERS[c][0] if c in NUMBERS else f"S{c}" for c in codes]
    width = sum(np.dtype(k).itemsize for k in kinds)
    return Layout(names, [k.lstrip("<>") for k in kinds], [NUMBERS[c][1] if c in NUMBERS else None for c in codes], label_sets, order, file.tell(), width, rows)


def read_labels(file, layout: Layout, encoding: str) -> dict[str, dict[int, str]]:
    """The value labels behind the rows, by name of the set."""
    file.seek(layout.start + layout.width * layout.rows)
    out = {}
    while len(size := file.read(4)) == 4:
        name = text(file.read(NAME), encoding)
        file.read(3)
        body = file.read(int(np.frombuffer(size, layout.order + "i4")[0]))
        n, _ = np.frombuffer(body, layout.order + "i4", 2).tolist()
        places, values = np.frombuffer(body, layout.order + "i4", 2 * n, 8).reshape(2, n).tolist()
        words = body[8 + 8 * n :]
        out[name] = {v: text(words[p:], encoding) for p, v in zip(places, values, strict=True)}
    return out


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


class StataReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.columns, self.types = (json.loads(options[k]) for k in ("paths", "columns", "types"))
        self.size, self.encoding = int(options["range"]), options["encoding"]

    def partitions(self) -> list[Rows]:
        out = []
        for path in self.paths:
            file, _ = open_file(path)
            with file:
                layout = read_layout(file, self.encoding)
            found = [layout.spark_type(c) if c in layout.names else None for c in self.columns]
            if found != self.types:
                raise ValueError(f"the columns {self.columns} of {path} are {found}, not {self.types}")
            step = max(1, self.size // max(1, layout.width))
            out += [Rows(path, a, min(layout.rows, a + step)) for a in range(0, layout.rows, step)]
        return out or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        schema = pa.schema([(c, kinds[t]) for c, t in zip(self.columns, self.types, strict=True)])
        file, _ = open_file(part.path)
        with file:
            layout = read_layout(file, self.encoding)
            labels = read_labels(file, layout, self.encoding) if any(layout.label_of(c) for c in self.columns) else {}
            row = np.dtype([(f"f{i}", k if k[0] == "S" else layout.order + k) for i, k in enumerate(layout.kinds)])
            step = max(1, BATCH // max(1, layout.width))
            for a in range(part.first, part.last, step):
                n = min(step, part.last - a)
                file.seek(layout.start + a * layout.width)
                raw = file.read(n * layout.width)
                if len(raw) < n * layout.width:
                    raise ValueError(f"{part.path} ends within its rows")
                table = np.frombuffer(raw, row)
                arrays = [self.column(table, layout, labels, c, f.type) for c, f in zip(self.columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def column(self, table: np.ndarray, layout: Layout, labels: dict, name: str, kind: pa.DataType) -> pa.Array:
        i = layout.names.index(name)
        v = table[f"f{i}"]
        if layout.most[i] is None:
            return pa.array([text(x, self.encoding) or None for x in v.tolist()], kind)
        missing = v > layout.most[i]
        if kind == pa.string():
            words = labels.get(layout.label_of(name), {})
            return pa.array([None if m else words.get(x, f"{x:g}") for x, m in zip(v.tolist(), missing.tolist(), strict=True)], kind)
        return pa.array(v.astype(np.int32 if kind == pa.int32() else np.float64), kind, mask=missing)


class StataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stata"

    def schema(self) -> str:
        pairs = zip(json.loads(self.options["columns"]), json.loads(self.options["types"]), strict=True)
        return ", ".join(f"`{c}` {t}" for c, t in pairs)

    def reader(self, schema) -> StataReader:
        return StataReader(dict(self.options))


def read_stata(spark: SparkSession, paths: list[str], columns: list[str] | None = None, range_bytes: int = RANGE, encoding: str = "latin-1") -> DataFrame:
    """The rows of Stata files, of all columns of the first or of those named, in any order.

    Whole numbers are ``int``, others ``double``, texts and numbers with value labels ``string``. Missing values of any kind and
    empty texts are NULL; a number that its labels do not name becomes its own text. All files must have the columns, of the same
    types. No path, a column that is not there, or another format is an error; a file without rows gives none.
    """
    if not paths:
        raise ValueError("no file to take the columns from")
    for module in (framed, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(StataSource)
    file, _ = open_file(paths[0])
    with file:
        layout = read_layout(file, encoding)
    wanted = columns or layout.names
    if absent := [c for c in wanted if c not in layout.names]:
        raise ValueError(f"columns not in {paths[0]}: {absent}")
    given = {"paths": paths, "columns": wanted, "types": [layout.spark_type(c) for c in wanted]}
    options = {k: json.dumps(v) for k, v in given.items()}
    return spark.read.format("stata").options(**options, range=str(range_bytes), encoding=encoding).load()
