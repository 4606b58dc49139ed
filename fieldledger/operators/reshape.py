"""Pivots, unpivots, unions and nearest-cell lookup."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.functions.nulls import ratio


def pivot_wide(df: DataFrame, ids: list[str], key: str, values: list[str], measure: str, suffix: str = "") -> DataFrame:
    """Long to wide over a fixed list of key values; combinations without rows are zero."""
    out = df.groupBy(*ids).pivot(key, values).agg(F.sum(measure))
    return out.select(*ids, *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(f"{v}{suffix}") for v in values])


def pivot_measures(df: DataFrame, ids: list[str], key: str, values: list[str], measures: list[str]) -> DataFrame:
    """Several measures pivoted in one pass, with a total per measure: ``<value>_<measure>``, ``total_<measure>``."""
    # sums of their own for each cell need one shuffle, a pivot two
    cells = {f"{v}_{m}": F.sum(F.when(F.col(key) == v, F.col(m))) for v in values for m in measures}
    out = df.groupBy(*ids).agg(*[F.coalesce(c, F.lit(0.0)).alias(name) for name, c in cells.items()])
    return out.select(
        *ids,
        *[F.col(f"`{name}`") for name in cells],
        *[reduce(add, [F.col(f"`{v}_{m}`") for v in values]).alias(f"total_{m}") for m in measures],
    )


def unit_prices(wide: DataFrame, ids: list[str], values: list[str], cost: str, qty: str) -> DataFrame:
    """Cost over quantity for each pivoted value and for the total, matched by row."""
    names = [*values, "total"]
    return wide.select(*ids, *[ratio(f"{v}_{cost}", f"{v}_{qty}").alias(f"{v}_price") for v in names])


def unpivot_long(df: DataFrame, ids: list[str], cols: list[str], key: str = "variable", value: str = "val") -> DataFrame:
    return df.unpivot(ids, cols, key, value)


def activity_totals(df: DataFrame, activity: str, measures: list[str]) -> DataFrame:
    """Total per activity and measure, long. Aggregates first, so only totals are reshaped."""
    wide = df.groupBy(activity).agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in measures])
    return wide.unpivot([activity], measures, "measure", "qty")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def stack_items(tables: dict[str, DataFrame], id_col: str, value_col: str) -> DataFrame:
    """Stack tables of ``id, value`` into one long ``id, item, value`` table."""
    return union_all(
        [t.select(id_col, F.lit(item).alias("item"), F.col(value_col).alias("value")) for item, t in tables.items()]
    )


def item_vector(long: DataFrame, ids: list[str], items: dict[str, str]) -> DataFrame:
    """Look up several items of a long table per id: ``items`` maps item to column name."""
    return long.groupBy(*ids).agg(
        *[F.max(F.when(F.col("item") == i, F.col("value"))).alias(name) for i, name in items.items()]
    )


def nearest_cell(grid: DataFrame, keys: list[str], value: str, point: float, payload: list[str]) -> DataFrame:
    """Grid row nearest to a point per key (the lower one on a tie)."""
    best = F.struct(F.abs(F.col(value) - F.lit(point)).alias("gap"), F.col(value).alias(value), *payload)
    return grid.groupBy(*keys).agg(F.min(best).alias("_b")).select(*keys, *[f"_b.{c}" for c in (value, *payload)])
