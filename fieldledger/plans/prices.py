"""Price-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldledger.functions import rounded
from fieldledger.operators import series as S
from fieldledger.plans.registry import query, rnd, sql_log
from fieldledger.plans.rollups import MARKET_YEAR_SQL, market_months
from fieldledger.plans.views import (
    DAILY_SQL,
    MONTHLY_SQL,
    USER_DAILY_SQL,
    daily_quotes,
    day_text,
    monthly_prices,
    table,
)


def _change(entity: str, source: str) -> str:
    x = sql_log("price")
    return f"SELECT *, {x} - lag({x}) OVER (PARTITION BY {entity} ORDER BY date) AS log_change FROM {source}"


@query(
    "log_change_rows",
    f"""WITH {DAILY_SQL}, ch AS ({_change("market", "daily")})
        SELECT market, strftime(date, '%Y-%m-%d') AS day, {rnd("price", 6)} AS price, {rnd("log_change", 6)} AS log_change
        FROM ch""",
)
def log_change_rows(spark, d):
    out = S.log_change(daily_quotes(spark, d), "market")
    return out.select(
        "market", day_text("date").alias("day"), rounded("price", 6).alias("price"),
        rounded("log_change", 6).alias("log_change"),
    )


DENSE_SQL = (
    USER_DAILY_SQL
    + """,
span AS (SELECT trader, min(date) AS a, max(date) AS b FROM daily GROUP BY trader),
cal AS (SELECT trader, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
dense AS (SELECT c.trader, c.date, d.price FROM cal c LEFT JOIN daily d ON c.trader = d.trader AND c.date = d.date)"""
)


@query(
    "densify_calendar",
    f"WITH {DENSE_SQL} SELECT trader, strftime(date, '%Y-%m-%d') AS day, {rnd('price', 6)} AS price FROM dense",
)
def densify_calendar(spark, d):
    out = S.densify(daily_quotes(spark, d, "user_id", "trader"), "trader")
    return out.select("trader", day_text("date").alias("day"), rounded("price", 6).alias("price"))


@query(
    "log_change_calendar",
    f"""WITH {DENSE_SQL}, ch AS ({_change("trader", "dense")})
        SELECT trader, strftime(date, '%Y-%m-%d') AS day, {rnd("log_change", 6)} AS log_change FROM ch""",
)
def log_change_calendar(spark, d):
    out = S.log_change_calendar(daily_quotes(spark, d, "user_id", "trader"), "trader")
    return out.select("trader", day_text("date").alias("day"), rounded("log_change", 6).alias("log_change"))


@query(
    "log_change_weekdays",
    f"""WITH {DENSE_SQL}, wk AS (SELECT * FROM dense WHERE isodow(date) < 6), ch AS ({_change("trader", "wk")})
        SELECT trader, strftime(date, '%Y-%m-%d') AS day, {rnd("log_change", 6)} AS log_change FROM ch""",
)
def log_change_weekdays(spark, d):
    out = S.log_change_calendar(daily_quotes(spark, d, "user_id", "trader"), "trader", weekdays_only=True)
    return out.select("trader", day_text("date").alias("day"), rounded("log_change", 6).alias("log_change"))


SEASON = {"anchor_month": 3, "length": 12}
SEASON_SQL = (
    MONTHLY_SQL
    + f""",
ch AS ({_change("market", "monthly")}),
sea AS (
  SELECT *, CAST(year(date) - CASE WHEN month(date) < 3 THEN 1 ELSE 0 END AS INTEGER) AS season,
         CAST((month(date) + 9) % 12 AS INTEGER) AS step FROM ch)"""
)


@query(
    "season_drift",
    f"""WITH {SEASON_SQL} SELECT market, season, {rnd("avg(log_change)", 6)} AS m, {rnd("stddev_samp(log_change)", 6)} AS s,
        CAST(count(log_change) AS BIGINT) AS n FROM sea GROUP BY market, season""",
)
def season_drift(spark, d):
    out = S.season_drift(monthly_prices(spark, d), "market", **SEASON)
    return out.select("market", "season", rounded("m", 6).alias("m"), rounded("s", 6).alias("s"), "n")


@query(
    "season_drift_overlapping",
    f"""WITH {MONTHLY_SQL}, ch AS ({_change("market", "monthly")}),
        w AS (SELECT c.market, s.season, c.log_change,
              (year(c.date) - s.season) * 12 + month(c.date) - 7 AS step FROM ch c JOIN
              (SELECT DISTINCT year(date) AS season FROM monthly UNION SELECT DISTINCT year(date) - 1 FROM monthly
               UNION SELECT DISTINCT year(date) - 2 FROM monthly) s
              ON (year(c.date) - s.season) * 12 + month(c.date) - 7 BETWEEN 0 AND 13)
        SELECT market, CAST(season AS INTEGER) AS season, {rnd("avg(CASE WHEN step > 0 THEN log_change END)", 6)} AS m,
        {rnd("stddev_samp(CASE WHEN step > 0 THEN log_change END)", 6)} AS s,
        CAST(count(CASE WHEN step > 0 THEN log_change END) AS BIGINT) AS n FROM w GROUP BY market, season""",
)
def season_drift_overlapping(spark, d):
    """Fourteen-month windows from July, differenced within the window."""
    out = S.season_drift(monthly_prices(spark, d), "market", 7, 14, within=True)
    return out.select("market", "season", rounded("m", 6).alias("m"), rounded("s", 6).alias("s"), "n")


@query(
    "expected_price_anomaly",
    f"""WITH {SEASON_SQL}, g AS (SELECT market, season, avg(log_change) AS m, max(CASE WHEN step = 0 THEN price END) AS p0,
          max(CASE WHEN step = 5 THEN price END) AS pt FROM sea GROUP BY market, season),
        e AS (SELECT *, p0 * exp(CASE WHEN lag(season) OVER w = season - 1 THEN lag(m) OVER w END * 5) AS expected FROM g
          WINDOW w AS (PARTITION BY market ORDER BY season))
        SELECT market, season, {rnd("p0", 4)} AS p0, {rnd("pt", 4)} AS pt, {rnd("expected", 4)} AS expected,
        {rnd("100 * (expected / nullif(pt, 0) - 1)", 6)} AS anomaly_pct FROM e""",
)
def expected_price_anomaly(spark, d):
    out = S.expected_price_anomaly(monthly_prices(spark, d), "market", horizon=5, **SEASON)
    return out.select(
        "market",
        "season",
        *[rounded(c, 4).alias(c) for c in ("p0", "pt", "expected")],
        rounded("anomaly_pct", 6).alias("anomaly_pct"),
    )


# Up and down weeks of the quote month play the part of up and down years.
WEEK_SQL = (
    DAILY_SQL
    + f""",
ch AS ({_change("market", "daily")}),
reg AS (
  SELECT *, CAST(isoyear(date) * 100 + week(date) AS INTEGER) AS wk, CAST(isodow(date) AS INTEGER) AS dow,
         CASE WHEN week(date) % 2 = 1 THEN 'up' ELSE 'down' END AS regime FROM ch),
drift AS (SELECT regime, avg(log_change) AS m, stddev_samp(log_change) AS s FROM reg GROUP BY regime),
anchor AS (
  SELECT market, wk, regime, coalesce(avg(CASE WHEN dow = 2 THEN price END),
         avg(CASE WHEN dow BETWEEN 1 AND 3 THEN price END)) AS p0 FROM reg GROUP BY market, wk, regime),
expect AS (
  SELECT a.market, a.wk, a.regime, a.p0, d.m, d.s, a.p0 * exp(d.m * 4) AS expected
  FROM anchor a JOIN drift d ON a.regime = d.regime WHERE a.p0 IS NOT NULL)"""
)


def weekly_expected(spark, d):
    changes = S.log_change(daily_quotes(spark, d), "market").withColumns(
        {
            # ISO year and week, so that the same week of another year is another one
            "wk": F.extract(F.lit("YEAROFWEEK"), F.col("date")) * 100 + F.weekofyear("date"),
            "dow": F.weekday("date") + 1,
            "regime": F.when(F.weekofyear("date") % 2 == 1, "up").otherwise("down"),
        }
    )
    anchors = S.price_at_anchor(changes, ["market", "wk", "regime"], F.col("dow"), "price", 2, (1, 3))
    return changes, S.expected_by_regime(anchors, S.drift_by_regime(changes), 4)


@query(
    "regime_expected_price",
    f"""WITH {WEEK_SQL} SELECT market, wk, regime, {rnd("p0", 6)} AS p0, {rnd("m", 6)} AS m, {rnd("s", 6)} AS s,
        {rnd("expected", 6)} AS expected FROM expect""",
)
def regime_expected_price(spark, d):
    _, out = weekly_expected(spark, d)
    return out.select(
        "market", "wk", "regime", *[rounded(c, 6).alias(c) for c in ("p0", "m", "s", "expected")]
    )


@query(
    "forecast_anomaly",
    f"""WITH {WEEK_SQL}, fin AS (SELECT market, wk, price AS pt FROM reg WHERE dow IN (5, 6)),
        a AS (SELECT e.wk, e.expected, 100 * (e.expected - f.pt) / nullif(f.pt, 0) AS anom FROM expect e JOIN fin f
              ON e.market = f.market AND e.wk = f.wk)
        SELECT wk, {rnd("avg(expected)", 6)} AS mean_expected, {rnd("avg(anom)", 5)} AS mean_anomaly FROM a GROUP BY wk""",
)
def forecast_anomaly(spark, d):
    changes, expected = weekly_expected(spark, d)
    final = changes.filter(F.col("dow").isin(5, 6)).select("market", "wk", F.col("price").alias("pt"))
    out = S.forecast_anomaly(expected, final, ["market", "wk"])
    return out.groupBy("wk").agg(
        rounded(F.avg("expected"), 6).alias("mean_expected"), rounded(F.avg("anomaly_pct"), 5).alias("mean_anomaly")
    )


@query(
    "price_at_anchor",
    f"""WITH {MARKET_YEAR_SQL} SELECT market, yr, {rnd('''coalesce(avg(CASE WHEN mon = 3 THEN price END),
          avg(CASE WHEN mon BETWEEN 2 AND 4 THEN price END))''', 4)} AS p0,
        max(CASE WHEN mon = 3 THEN 1 ELSE 0 END) AS at_anchor FROM my GROUP BY market, yr
        HAVING count(CASE WHEN mon BETWEEN 2 AND 4 THEN 1 END) > 0""",
)
def price_at_anchor(spark, d):
    out = S.price_at_anchor(market_months(spark, d), ["market", "yr"], F.col("mon"), "price", 3, (2, 4))
    return out.withColumn("p0", rounded("p0", 4))


# Regimes by year: odd years play the part of the up years.
YEARLY_SQL = (
    MONTHLY_SQL
    + f""",
ych AS ({_change("market", "monthly")}),
yreg AS (
  SELECT *, CAST(year(date) AS INTEGER) AS yr, CAST(month(date) AS INTEGER) AS mon,
         CASE WHEN year(date) % 2 = 1 THEN 'up' ELSE 'down' END AS regime FROM ych),
ydrift AS (SELECT regime, avg(log_change) AS m, stddev_samp(log_change) AS s FROM yreg GROUP BY regime),
yanchor AS (
  SELECT market, yr, regime, coalesce(avg(CASE WHEN mon = 3 THEN price END),
         avg(CASE WHEN mon BETWEEN 2 AND 4 THEN price END)) AS p0 FROM yreg GROUP BY market, yr, regime),
yexpect AS (
  SELECT a.market, a.yr, a.regime, a.p0, d.m, d.s, a.p0 * exp(d.m * 5) AS expected
  FROM yanchor a JOIN ydrift d ON a.regime = d.regime WHERE a.p0 IS NOT NULL),
yfinal AS (SELECT market, yr, avg(price) AS pt FROM yreg WHERE mon BETWEEN 8 AND 10 GROUP BY market, yr)"""
)


def yearly_expected(spark, d):
    changes = S.log_change(monthly_prices(spark, d), "market").withColumns(
        {
            "yr": F.year("date"),
            "mon": F.month("date"),
            "regime": F.when(F.year("date") % 2 == 1, "up").otherwise("down"),
        }
    )
    anchors = S.price_at_anchor(changes, ["market", "yr", "regime"], F.col("mon"), "price", 3, (2, 4))
    return changes, S.expected_by_regime(anchors, S.drift_by_regime(changes), 5)


@query(
    "regime_expected_price_yearly",
    f"""WITH {YEARLY_SQL} SELECT market, yr, regime, {rnd("p0", 4)} AS p0, {rnd("m", 8)} AS m, {rnd("s", 8)} AS s,
        {rnd("expected", 4)} AS expected FROM yexpect""",
)
def regime_expected_price_yearly(spark, d):
    _, out = yearly_expected(spark, d)
    digits = {"p0": 4, "m": 8, "s": 8, "expected": 4}
    return out.select("market", "yr", "regime", *[rounded(c, n).alias(c) for c, n in digits.items()])


@query(
    "forecast_anomaly_yearly",
    f"""WITH {YEARLY_SQL} SELECT e.market, e.yr, {rnd("e.expected", 4)} AS expected, {rnd("f.pt", 4)} AS realised,
        {rnd("100 * (e.expected - f.pt) / nullif(f.pt, 0)", 6)} AS anomaly_pct
        FROM yexpect e JOIN yfinal f ON e.market = f.market AND e.yr = f.yr""",
)
def forecast_anomaly_yearly(spark, d):
    changes, expected = yearly_expected(spark, d)
    realised = changes.filter(F.col("mon").between(8, 10)).groupBy("market", "yr").agg(F.avg("price").alias("pt"))
    out = S.forecast_anomaly(expected, realised, ["market", "yr"])
    return out.select(
        "market", "yr", rounded("expected", 4).alias("expected"), rounded("pt", 4).alias("realised"),
        rounded("anomaly_pct", 6).alias("anomaly_pct"),
    )


@query(
    "weather_daily",
    f"""WITH hourly AS (
          SELECT CAST(ts AS DATE) AS date, value, value * value AS squared FROM events
          WHERE hour(ts) BETWEEN 7 AND 18 AND month(ts) BETWEEN 1 AND 7),
        day AS (SELECT date, avg(value) AS value, avg(squared) AS squared FROM hourly GROUP BY date),
        long AS (SELECT date, 'value' AS market, value AS price FROM day UNION ALL SELECT date, 'squared', squared FROM day),
        ch AS ({_change("market", "long")})
        SELECT strftime(date, '%Y-%m-%d') AS day, market AS variable, {rnd("price", 4)} AS value,
        {rnd("log_change", 6)} AS log_change FROM ch""",
)
def weather_daily(spark, d):
    ts = F.col("ts")
    hourly = table(spark, d, "events").select(
        F.year(ts).alias("year"), F.month(ts).alias("month"), F.day(ts).alias("day"), F.hour(ts).alias("hour"),
        "value", (F.col("value") * F.col("value")).alias("squared"),
    )
    out = S.weather_daily(hourly, (7, 18), (1, 7), ["value", "squared"])
    return out.select(
        day_text("date").alias("day"), "variable", rounded("value", 4).alias("value"),
        rounded("log_change", 6).alias("log_change"),
    )
