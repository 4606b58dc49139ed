"""Grouped sums, means, ratios, counts and subtotals. All combine map-side before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.functions.nulls import ratio
from fieldledger.operators.joins import summary_join, with_scalars


def sum_safe(c: str | Column) -> Column:
    """Sum where a group without values gives zero."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def group_sum(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[sum_safe(c).alias(c) for c in cols])


def group_mean(df: DataFrame, keys: list[str], cols: list[str], drop_missing: bool = False) -> DataFrame:
    """Mean per group; ``drop_missing`` removes groups whose mean is missing."""
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])
    return out.dropna("any", subset=cols) if drop_missing else out


def summarise_all(df: DataFrame, keys: list[str], fn) -> DataFrame:
    """One aggregate over every column that is not a key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[fn(c).alias(c) for c in rest])


def mixed_rollup(df: DataFrame, keys: list[str], sums: list[str], means: list[str]) -> DataFrame:
    """Sum the continuous columns and average the dummies in one shuffle."""
    return df.groupBy(*keys).agg(*[sum_safe(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])


def ratio_of_sums(df: DataFrame, keys: list[str], num: str, den: str, name: str) -> DataFrame:
    out = df.groupBy(*keys).agg(sum_safe(num).alias(num), sum_safe(den).alias(den))
    return out.withColumn(name, ratio(num, den))


def with_subtotal(df: DataFrame, keys: list[str], item: str, cols: list[str], label: str = "Total") -> DataFrame:
    """Sums per item plus one row per group over all items, from one grouping-sets pass."""
    # a fine pre-aggregate first: the grouping sets then expand one row per group, not the input
    fine = df.groupBy(*keys, item).agg(*[sum_safe(c).alias(c) for c in cols])
    sets = [[F.col(c) for c in [*keys, item]], [F.col(c) for c in keys]]
    out = fine.groupingSets(sets, *[F.col(c) for c in [*keys, item]]).agg(
        *[sum_safe(c).alias(c) for c in cols], F.grouping(item).alias("_is_total")
    )
    return out.withColumn(item, F.when(F.col("_is_total") == 1, F.lit(label)).otherwise(F.col(item))).drop("_is_total")


def group_share(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row count per group and its percentage of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n_total"))
    return with_scalars(counts, total).withColumn("pct", 100 * F.col("n") / F.col("n_total"))


def condition_rate(df: DataFrame, keys: list[str], condition: Column, name: str = "rate") -> DataFrame:
    """Share of rows meeting a condition; an unknown condition counts as not met."""
    return df.groupBy(*keys).agg(F.avg(F.when(condition, 1.0).otherwise(0.0)).alias(name))


def share_of_group(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Percentage of the group total on every row.

    Totals are aggregated and joined back, so a group of any size is never gathered in one task.
    """
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return summary_join(df, totals, keys).withColumn(name, 100 * ratio(value, "_total")).drop("_total")


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once, with the number of occurrences."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    return summary_join(df, repeated, keys, rows="n_rows")


def largest_cohort(df: DataFrame, key: str) -> DataFrame:
    """Rows sharing the most frequent key value (the smallest such value on a tie); a missing value is none."""
    top = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), F.asc(key)).limit(1)
    return df.join(F.broadcast(top.select(key)), [key], "left_semi")


def single_valued(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Groups in which a column that should be constant takes several values (empty when sound)."""
    return (
        df.groupBy(*keys)
        .agg(F.min(col).alias("lowest"), F.max(col).alias("highest"))
        .filter(F.col("lowest") != F.col("highest"))
    )

