"""CSV layouts met in the survey and price files. Every reader names its schema: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.functions.dates import parse_day, parse_month_year

BOM = "﻿"


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_market_prices(spark: SparkSession, paths: list[str], market_pattern: str) -> DataFrame:
    """Monthly price files whose header is preceded by a title: keep the rows dated ``January-2006``.

    One scan over all files; the market is the part of the file name that ``market_pattern`` captures.
    """
    raw = spark.read.schema("date_text string, price_text string").option("header", False).csv(paths)
    name = F.regexp_replace(F.col("_metadata.file_name"), "%20", " ")
    return (
        raw.select(
            F.regexp_extract(name, market_pattern, 1).alias("market"),
            parse_month_year("date_text").alias("date"),
            F.round(F.col("price_text").try_cast("double"), 2).alias("price"),
        )
        .filter(F.col("date").isNotNull())
    )


def read_quote_prices(spark: SparkSession, path: str, markets: list[str]) -> DataFrame:
    """Wide quote file (``M/d/yyyy`` plus one price column per market) in long form; blanks are NULL."""
    schema = "date_text string, " + ", ".join(f"`{m}` string" for m in markets)
    raw = spark.read.schema(schema).option("header", True).csv(path)
    wide = raw.select(
        parse_day("date_text", "M/d/yyyy").alias("date"),
        *[F.col(m).try_cast("double").alias(m) for m in markets],
    )
    return wide.unpivot(["date"], markets, "market", "price")


def read_promoted_header(
    spark: SparkSession, path: str, columns: list[str], keep: list[str], key: str
) -> DataFrame:
    """File with metadata rows above the real header: keep the rows whose ``key`` is a number.

    ``columns`` names every field by position; only ``keep`` is returned, as doubles.
    """
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", False).csv(path)
    # metadata rows have digits too, so a data row must be numeric in every kept column
    numeric = [F.col(f"`{c}`").try_cast("double") for c in keep]
    out = raw.select(*[n.alias(c) for n, c in zip(numeric, keep)], F.col(f"`{key}`").alias("_key"))
    ok = F.col("_key").rlike(r"^\d{4}$")
    for c in keep:
        ok = ok & F.col(f"`{c}`").isNotNull()
    return out.filter(ok).drop("_key")


def read_trailing_header(spark: SparkSession, path: str, names: list[str], text_columns: list[str]) -> DataFrame:
    """File that repeats its (unmangled) header as the last row.

    Row order is no property of a distributed scan, so the trailer is dropped by content: it is the
    row that equals ``names`` in every field.
    """
    raw = (
        spark.read.schema(", ".join(f"c{i} string" for i in range(len(names))))
        .option("header", True)
        .csv(path)
    )
    is_trailer = F.lit(True)
    for i, n in enumerate(names):
        is_trailer = is_trailer & F.col(f"c{i}").eqNullSafe(F.lit(n))
    return raw.filter(~is_trailer).select(
        *[
            (F.col(f"c{i}") if n in text_columns else F.col(f"c{i}").try_cast("double")).alias(n)
            for i, n in enumerate(names)
        ]
    )


def read_county_production(spark: SparkSession, path: str) -> DataFrame:
    """Official production by county: byte-order mark, ``"39,753"`` numbers, and a range check.

    A negative area or production is a data error and becomes NULL with ``valid = 0``.
    """
    raw = (
        spark.read.schema("id string, county string, year string, area string, production string, yield string")
        .option("header", True)
        .option("encoding", "UTF-8")
        .csv(path)
    )

    def number(c: str):
        return F.regexp_replace(c, ",", "").try_cast("double")

    typed = raw.select(
        F.regexp_replace("id", BOM, "").try_cast("int").alias("id"),
        F.trim("county").alias("county"),
        F.col("year").try_cast("int").alias("year"),
        number("area").alias("area_ha"),
        number("production").alias("production_mt"),
        number("yield").alias("yield_mt_ha"),
    )
    bad = (F.col("area_ha") < 0) | (F.col("production_mt") < 0)
    flagged = typed.withColumn("valid", F.when(bad, 0).otherwise(1))
    return flagged.withColumns(
        {c: F.when(F.col("valid") == 1, F.col(c)) for c in ("area_ha", "production_mt", "yield_mt_ha")}
    )

