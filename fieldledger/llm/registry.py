"""Names, builders and SQL twins of the document queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class DocQuery:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, DocQuery] = {}


def doc_query(name: str, sql: str | None = None):
    """Register ``fn(spark, directory) -> DataFrame``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = DocQuery(name, fn, sql)
        return fn

    return add


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
