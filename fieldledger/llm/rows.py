"""Apply per-document work inside tasks, in Arrow batches cut into pieces of bounded size.

Every operator that looks at one document at a time goes through ``map_rows``: a narrow stage without a
shuffle, whose tasks can be repeated on another executor with the same result. Only the named input columns
travel to the workers, so further columns of the table, whatever their names, play no part.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from fieldledger.operators.lineage import shared_folder

# A piece of a batch holds at most so many rows and, if it is more than one row, so many bytes.
PIECE_ROWS = 512
PIECE_BYTES = 4 << 20
#: So many output rows are handed on at a time, however many a piece yields.
OUTPUT_ROWS = 8192


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that are safe to turn into Python objects at once."""
    per_row = batch.nbytes / max(1, batch.num_rows)
    step = int(max(1, min(PIECE_ROWS, PIECE_BYTES / max(1.0, per_row))))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their workers can import it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if context.applicationId in _shipped or not os.path.isdir(root):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "fieldledger_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_rows(df: DataFrame, inputs: list[Column], ddl: str, make: Callable[[], Callable[..., Iterable[tuple]]], at_end: bool = False) -> DataFrame:
    """Rows made by ``make()``'s function from the input columns.

    ``make`` runs once per task and returns ``fn(*columns)``, which gets each piece as Python lists and yields
    output rows as tuples in the order of ``ddl``. With ``at_end`` it returns ``read, done``: ``read(*columns)`` only
    takes pieces in, and ``done()`` yields the rows after the last.
    """
    ship_package(df.sparkSession)
    arrow = to_arrow_schema(schema_of(ddl))

    def out(made: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        made = iter(made)
        while rows := list(islice(made, OUTPUT_ROWS)):
            columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), arrow.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, done = make() if at_end else (make(), None)
        for batch in batches:
            for piece in pieces(batch):
                made = fn(*[c.to_pylist() for c in piece.columns])
                if not at_end:
                    yield from out(made)
        if done is not None:
            yield from out(done())

    named = [c.alias(f"c{i}") for i, c in enumerate(inputs)]
    return df.select(*named).mapInArrow(run, ddl)


def edit_rows(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]], keep: bool = False) -> DataFrame:
    """The same columns, with the text replaced or, with ``keep``, only some of the rows.

    ``make`` runs once per task and returns a function from the texts of a piece to their replacements or, with
    ``keep``, to whether each row stays. A missing text arrives as None.
    """
    ship_package(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for piece in pieces(batch):
                made = fn(piece.column(at).to_pylist())
                if keep:
                    yield piece.filter(pa.array(made, pa.bool_()))
                else:
                    columns = [*piece.columns]
                    columns[at] = pa.array(made, columns[at].type)
                    yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    return df.mapInArrow(run, df.schema)


def shared_table(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read into the folder the session names, and read it back.

    The written rows outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docs-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
