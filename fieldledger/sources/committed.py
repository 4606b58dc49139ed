"""Delimited files that all tasks write and the driver commits, so that a task that is run again leaves no second file.

A Python data source. Each attempt of a task writes a file of its own into a pending folder and tells the driver its
name and number of rows. On commit the driver moves the files of the attempts that Spark accepted to the folder and then writes a manifest of
them; on abort it removes the pending folder. Readers go by the manifests, so what a driver lost during its
commit leaves behind is not read either.

Files begin with the header and, if asked for, repeat it as last line, as ``read_framed`` takes them.
"""

from __future__ import annotations

import csv
import io
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from fieldledger.sources import framed
from fieldledger.sources.framed import locate

MANIFEST = "_manifest-"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


def delimited(rows: Iterator[tuple]) -> bytes:
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n")
    for row in rows:
        if any(v is not None and ("\n" in v or "\r" in v) for v in row):
            raise ValueError("a field holds a line break, which these files cannot keep")
        writer.writerow(row)
    return text.getvalue().encode()


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, job: str):
        self.folder, self.job = options["path"].rstrip("/"), job
        self.header, self.trailer = json.loads(options["header"]), options["trailer"] == "true"

    @property
    def pending(self) -> str:
        return f"{self.folder}/_pending-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file per attempt, under a name no other attempt has; a task without rows writes none."""
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        name, rows, out = f"part-{part:06d}-{uuid.uuid4().hex}.csv", 0, None
        edge = delimited(iter([tuple(self.header)]))
        store, path = locate(f"{self.pending}/{name}")
        try:
            for batch in iterator:
                if batch.num_rows == 0:
                    continue
                if out is None:
                    store.create_dir(locate(self.pending)[1], recursive=True)
                    out = store.open_output_stream(path)
                    out.write(edge)
                out.write(delimited(zip(*[c.to_pylist() for c in batch.columns], strict=True)))
                rows += batch.num_rows
            if out is not None and self.trailer:
                out.write(edge)
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        kept = sorted((m.name, m.rows) for m in messages if m is not None and m.name)
        store, folder = locate(self.folder)
        store.create_dir(folder, recursive=True)
        for name, _ in kept:
            store.move(locate(f"{self.pending}/{name}")[1], f"{folder}/{name}")
        with store.open_output_stream(f"{folder}/{MANIFEST}{self.job}.json") as out:
            out.write(json.dumps({"files": kept}).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        store, path = locate(self.pending)
        if store.get_file_info(path).type == FileType.Directory:
            store.delete_dir(path)


class CommittedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema, overwrite: bool) -> CommittedWriter:
        if overwrite:
            raise ValueError("committed files are only added; write to a new folder instead")
        return CommittedWriter(dict(self.options), uuid.uuid4().hex)


def write_committed(df: DataFrame, folder: str, header: list[str] | None = None, trailer: bool = False) -> list[str]:
    """Add the rows to the folder as delimited files, one per task with rows, and return all its committed files.

    ``header`` names the columns in the files (their names unless given); ``trailer`` repeats it as the last line. Missing
    values become empty fields, and so do empty strings, which ``read_framed`` reads as NULL. A field with a line break
    is an error, and nothing is added then. No rows add no file.
    """
    if header is not None and len(header) != len(df.columns):
        raise ValueError(f"{len(header)} names for {len(df.columns)} columns")
    # the classes travel by value, so the executors need not have this package
    for module in (framed, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    df.sparkSession.dataSource.register(CommittedSink)
    text = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    given = {"header": json.dumps(header or df.columns), "trailer": str(trailer).lower()}
    text.write.format("committed").mode("append").options(**given).save(folder)
    return committed_files(folder)


def committed_files(folder: str) -> list[str]:
    """Paths that the manifests of a folder name, in order; none where there is no folder."""
    from pyarrow.fs import FileSelector

    store, name = locate(folder.rstrip("/"))
    found = []
    for info in store.get_file_info(FileSelector(name, allow_not_found=True)):
        if info.base_name.startswith(MANIFEST):
            with store.open_input_file(info.path) as file:
                found += [f"{folder.rstrip('/')}/{n}" for n, _ in json.loads(file.read())["files"]]
    return sorted(found)
