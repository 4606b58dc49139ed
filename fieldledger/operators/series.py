"""Price and weather series: log changes, calendars, seasons, regimes and expected prices.

A series is one row per entity and period. Windows run over an entity's periods, whose number the
calendar bounds, so raw observations are always aggregated to the period first (``period_series``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.functions.dates import season_year
from fieldledger.functions.nulls import log_positive, ratio
from fieldledger.operators.joins import summary_join


def period_series(df: DataFrame, entity: str, period: Column, value: str, name: str = "price") -> DataFrame:
    """Mean value per entity and period: ``<entity>, date, <name>``."""
    return df.groupBy(entity, period.alias("date")).agg(F.avg(value).alias(name))


def _by_date(entity: str):
    return Window.partitionBy(entity).orderBy("date")


def log_change(df: DataFrame, entity: str, value: str = "price", name: str = "log_change") -> DataFrame:
    """Log change from the previous row of the series, whatever the gap between them."""
    x = log_positive(value)
    return df.withColumn(name, x - F.lag(x).over(_by_date(entity)))


def densify(df: DataFrame, entity: str, step: str = "day", weekdays_only: bool = False) -> DataFrame:
    """Every period between an entity's first and last, missing values NULL.

    Each row fills the gap up to the next one, so the series is read once and nothing is joined. Monthly
    dates are first days of months. ``weekdays_only`` removes Saturdays and Sundays afterwards.
    """
    following = F.lead("date").over(_by_date(entity))
    if step == "month":
        interval, last = F.expr("interval 1 month"), F.add_months(following, -1)
    else:
        interval, last = F.expr("interval 1 day"), F.date_sub(following, 1)
    values = [c for c in df.columns if c not in (entity, "date")]
    upto = df.withColumn("_last", F.coalesce(last, F.col("date")))
    filled = upto.select(
        entity, *values, F.posexplode(F.sequence("date", "_last", interval)).alias("_pos", "date")
    )
    out = filled.select(entity, "date", *[F.when(F.col("_pos") == 0, F.col(c)).alias(c) for c in values])
    return out.filter(F.weekday("date") < 5) if weekdays_only else out


def log_change_calendar(
    df: DataFrame, entity: str, step: str = "day", weekdays_only: bool = False, value: str = "price"
) -> DataFrame:
    """Log change from the previous calendar period; NULL on either side of a gap."""
    return log_change(densify(df, entity, step, weekdays_only), entity, value)


def season_windows(
    series: DataFrame,
    entity: str,
    anchor_month: int,
    length: int,
    value: str = "price",
    within: bool = False,
) -> DataFrame:
    """Rows of each season: ``season`` year and ``step`` months after the anchor month.

    A window longer than a year overlaps the next, and its rows are returned for both seasons. The
    log change is taken along the whole series, or ``within`` the window, whose first row then has none.
    """
    changed = log_change(series, entity, value)
    first = season_year("date", anchor_month)
    back = (length - 1) // 12
    seasons = F.transform(F.sequence(F.lit(0), F.lit(back)), lambda k: first - k)
    out = changed.withColumn("season", F.explode(seasons)).withColumn(
        "step", (F.year("date") - F.col("season")) * 12 + F.month("date") - F.lit(anchor_month)
    )
    out = out.filter(F.col("step") < length)
    if within:
        out = out.withColumn("log_change", F.when(F.col("step") > 0, F.col("log_change")))
    return out


def season_drift(
    series: DataFrame, entity: str, anchor_month: int, length: int, value: str = "price", within: bool = False
) -> DataFrame:
    """Mean and standard deviation of the log change per entity and season."""
    return (
        season_windows(series, entity, anchor_month, length, value, within)
        .groupBy(entity, "season")
        .agg(
            F.avg("log_change").alias("m"),
            F.stddev_samp("log_change").alias("s"),
            F.count("log_change").alias("n"),
        )
    )


def expected_price_anomaly(
    series: DataFrame, entity: str, anchor_month: int, length: int, horizon: int, value: str = "price"
) -> DataFrame:
    """Expected price at the horizon, from the anchor price and the previous season's drift.

    ``anomaly_pct`` compares it with the price observed at the horizon.
    """
    rows = season_windows(series, entity, anchor_month, length, value)
    per_season = rows.groupBy(entity, "season").agg(
        F.avg("log_change").alias("m"),
        F.stddev_samp("log_change").alias("s"),
        F.max(F.when(F.col("step") == 0, F.col(value))).alias("p0"),
        F.max(F.when(F.col("step") == horizon, F.col(value))).alias("pt"),
    )
    w = Window.partitionBy(entity).orderBy("season")
    previous = F.when(F.lag("season").over(w) == F.col("season") - 1, F.lag("m").over(w))
    return (
        per_season.withColumn("m_prev", previous)
        .withColumn("expected", F.col("p0") * F.exp(F.col("m_prev") * horizon))
        .withColumn("anomaly_pct", 100 * (ratio("expected", "pt") - 1))
    )


def drift_by_regime(changes: DataFrame, regime: str = "regime") -> DataFrame:
    """Drift and volatility of the log changes in each regime."""
    return changes.groupBy(regime).agg(F.avg("log_change").alias("m"), F.stddev_samp("log_change").alias("s"))


def price_at_anchor(
    df: DataFrame, keys: list[str], month: Column, price: str, anchor: int, near: tuple[int, int]
) -> DataFrame:
    """Price in the anchor month, or the mean over the neighbouring months when there is none.

    One grouped pass; ``at_anchor`` tells which. Groups with neither are left out.
    """
    at = F.avg(F.when(month == anchor, F.col(price)))
    around = F.avg(F.when(month.between(*near), F.col(price)))
    return (
        df.groupBy(*keys)
        .agg(at.alias("_at"), around.alias("_near"))
        .select(
            *keys,
            F.coalesce("_at", "_near").alias("p0"),
            F.when(F.col("_at").isNotNull(), 1).otherwise(0).alias("at_anchor"),
        )
        .filter(F.col("p0").isNotNull())
    )


def expected_by_regime(anchors: DataFrame, drift: DataFrame, horizon: int, regime: str = "regime") -> DataFrame:
    """Anchor price carried forward by its regime's drift, for anchor and fallback rows alike."""
    return summary_join(anchors, drift.select(regime, "m", "s"), [regime]).withColumn(
        "expected", F.col("p0") * F.exp(F.col("m") * horizon)
    )


def forecast_anomaly(expected: DataFrame, realised: DataFrame, keys: list[str]) -> DataFrame:
    """Percentage by which the expected price exceeds the realised price."""
    joined = expected.join(realised, keys)
    return joined.withColumn("anomaly_pct", 100 * ratio(F.col("expected") - F.col("pt"), "pt"))


def weather_daily(hourly: DataFrame, hours: tuple[int, int], months: tuple[int, int], measures: list[str]) -> DataFrame:
    """Daily mean of each measure over daylight hours of the season, long, with log changes."""
    day = F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"))
    kept = hourly.filter(F.col("hour").between(*hours) & F.col("month").between(*months))
    daily = kept.groupBy(day.alias("date")).agg(*[F.avg(c).alias(c) for c in measures])
    return log_change(daily.unpivot(["date"], measures, "variable", "value"), "variable", "value")
