"""Projection, renaming and column-set transforms, each a single ``select``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.functions.nulls import ratio


def project(df: DataFrame, keep: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Keep columns in the given order, renaming some. Names are checked up front."""
    require_columns(df, keep)
    rename = rename or {}
    return df.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in keep])


def require_columns(df: DataFrame, names: list[str]) -> None:
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ValueError(f"columns not in table: {absent}")


def rename_by_pattern(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Apply regex replacements to every column name, in order."""

    def new_name(name: str) -> str:
        for pattern, replacement in rules:
            name = re.sub(pattern, replacement, name)
        return name

    return df.toDF(*[new_name(c) for c in df.columns])


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns that match a regex, such as a unit suffix."""
    return [c for c in df.columns if re.search(pattern, c)]


def scale_columns(df: DataFrame, pattern: str, by: str, suffix: str) -> DataFrame:
    """Divide every matching column by ``by`` and append ``suffix`` to its name."""
    chosen = set(matching(df, pattern))
    return df.select(
        *[ratio(c, by).alias(c + suffix) if c in chosen else F.col(c) for c in df.columns]
    )


def transform_columns(df: DataFrame, cols: list[str], fn) -> DataFrame:
    """Apply one Column function to a set of columns."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def dummy_columns(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Replace string columns by 0/1 columns named ``<column>_<level>``, one for each given level.

    The levels are named by the caller, so that the schema does not depend on the data; ``level_rows`` needs none.
    Two levels whose names become equal once cleaned are refused.
    """
    exprs: dict[str, Column] = {}
    for c, known in levels.items():
        for v in known:
            name = f"{c}_" + re.sub(r"[^0-9a-z]+", "_", v.lower()).strip("_")
            if name in exprs or (name in df.columns and name not in levels):
                raise ValueError(f"level {v!r} of {c} gives the column {name} a second time")
            exprs[name] = F.when(F.col(c) == v, 1).otherwise(0)
    return df.withColumns(exprs).drop(*levels)


def level_rows(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """The long form of 0/1 columns: ``key, column, level, flag`` = 1 for every value that is not missing."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])
    long = df.select(F.col(key), F.explode(pairs).alias("_p")).select(key, "_p.column", "_p.level", F.lit(1).alias("flag"))
    return long.filter(F.col("level").isNotNull())


def threshold_flags(df: DataFrame, cols: list[str], threshold: float = 0.15) -> DataFrame:
    """Share to 0/1: one where the share reaches the threshold."""
    return df.withColumns({c: (F.col(c) >= threshold).cast("int") for c in cols})


def fill_missing(df: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    return df.fillna(value, subset=cols)


def fill_block(df: DataFrame, trigger: str, block: list[str], value: float = 0.0) -> DataFrame:
    """Where ``trigger`` is missing set the whole block, the trigger included, to ``value``."""
    missing = F.col(trigger).isNull()
    return df.withColumns({c: F.when(missing, F.lit(value)).otherwise(F.col(c)) for c in block})


def drop_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=cols)


def drop_where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Remove rows meeting any condition; an unknown condition keeps the row."""
    bad = F.lit(False)
    for c in conditions:
        bad = bad | F.coalesce(c, F.lit(False))
    return df.filter(~bad)


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count per column in one pass, long: ``column_name, n_missing``."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_missing")
