"""Parquet tables, small literal tables, and multi-file scans tagged by their source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Inline table for published figures and parameter sets."""
    return spark.createDataFrame(rows, schema)


def tag_source(df: DataFrame, pattern: str = r"/([^/]+)\.parquet(?:/|$)", column: str = "source") -> DataFrame:
    """Tag rows with the part of their path that ``pattern`` captures: a file's name, or that of a folder of parts."""
    return df.withColumn(column, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
