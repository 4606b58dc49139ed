"""Query registry and the small SQL-text helpers shared by the SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldledger.functions.normal import cdf_text, pdf_text


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, directory) -> DataFrame`` under a name, with the equivalent SQL if there is one."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, sql)
        return fn

    return add


def rnd(expr: str, digits: int) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def sql_log(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"


def sql_safe_log(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0.0 WHEN {x} > 0 THEN ln({x}) END)"


def duck_double(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def sql_pdf(z: str) -> str:
    return pdf_text(z, duck_double)


def sql_cdf(z: str) -> str:
    return cdf_text(z, duck_double)
