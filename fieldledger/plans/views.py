"""Survey-shaped views over the shared tables, and the same views as SQL common table expressions.

An order is a farm plot of a household (customer) in a district (nation); its line items are input
applications; events are market quotes of a price (``value``) per market (``event_type``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.functions import endowment_label, linear_score
from fieldledger.operators.joins import dimension_join
from fieldledger.operators.series import period_series
from fieldledger.sources import read_table

# Parameters of the fitted yield model: degree of homogeneity, endowments, controls, rainfall exponent.
H = 0.25
INTERCEPT = 2.0
ENDOWMENTS = {"hybrid": 0.35, "tenure": 0.10, "oxen": 0.20, "tractor": 0.15}
LABELS = {"hybrid": "Hybrid", "tenure": "Tenure", "oxen": "Oxen", "tractor": "Tractor"}
CONTROLS = {"log_area": -0.20, "log_seed": 0.10}
KAPPA_RAIN = 0.6
N_FARMS = 2_000_000.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


INPUT_KINDS = ["A", "N", "R"]


def inputs_by_plot(spark: SparkSession, d: str) -> DataFrame:
    """Applications summed per plot in one pass; sums a query does not use are pruned from the plan."""
    kind, kg, kes = F.col("l_returnflag"), F.col("l_quantity"), F.col("l_extendedprice")
    by_kind = [
        F.coalesce(F.sum(F.when(kind == v, c)), F.lit(0.0)).alias(f"{v}_{m}")
        for v in INPUT_KINDS
        for m, c in (("kg", kg), ("kes", kes))
    ]
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("farm_id"))
        .agg(
            F.sum(kg).alias("seed_kg"),
            F.sum(kes).alias("cost_kes"),
            F.count(F.lit(1)).cast("double").alias("area"),
            F.max(F.when(kind == "R", 1).otherwise(0)).alias("hybrid"),
            *by_kind,
        )
    )


def plots(spark: SparkSession, d: str) -> DataFrame:
    prio = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("farm_id"),
        F.col("o_custkey").alias("hhid"),
        F.col("o_totalprice").alias("harvest_kg"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("tenure"),
        F.when(prio.isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("oxen"),
        F.when(prio == "3-MEDIUM", 1).otherwise(0).alias("tractor"),
    )


def farms(spark: SparkSession, d: str) -> DataFrame:
    """One row per plot: logged yield, cost and controls per acre, endowment dummies and label."""
    return _with_inputs(plots(spark, d), spark, d)


def farms_by_district(spark: SparkSession, d: str) -> DataFrame:
    """Farms with the district of their household.

    The household join comes first, on the narrow plot table: should it have to salt, the hot
    households are counted from one column of one table.
    """
    homes = table(spark, d, "customer").select(
        F.col("c_custkey").alias("hhid"), F.col("c_nationkey").alias("district")
    )
    return _with_inputs(dimension_join(plots(spark, d), homes, ["hhid"]), spark, d)


def _with_inputs(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    # one row per plot on both sides, so no key repeats
    return (
        rows.join(inputs_by_plot(spark, d), "farm_id")
        .withColumns(
            {
                "yield": F.col("harvest_kg") / F.col("area"),
                "cost": F.col("cost_kes") / F.col("area"),
                "seed": F.col("seed_kg") / F.col("area"),
            }
        )
        .withColumns(
            {
                "log_yield": F.ln("yield"),
                "log_cost": F.ln("cost"),
                "log_area": F.ln("area"),
                "log_seed": F.ln("seed"),
                "log_v": linear_score(ENDOWMENTS, INTERCEPT),
                "label": endowment_label(LABELS),
            }
        )
    )


FARMS_SQL = """
inputs AS (
  SELECT l_orderkey AS farm_id, sum(l_quantity) AS seed_kg, sum(l_extendedprice) AS cost_kes,
         count(*)::DOUBLE AS area, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hybrid
  FROM lineitem GROUP BY l_orderkey),
plots AS (
  SELECT o_orderkey AS farm_id, o_custkey AS hhid, o_totalprice AS harvest_kg,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS tenure,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS oxen,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS tractor
  FROM orders),
farms AS (
  SELECT p.farm_id, hhid, harvest_kg, tenure, oxen, tractor, seed_kg, cost_kes, area, hybrid,
         harvest_kg / area AS yield, cost_kes / area AS cost, seed_kg / area AS seed,
         ln(harvest_kg / area) AS log_yield, ln(cost_kes / area) AS log_cost, ln(area) AS log_area,
         ln(seed_kg / area) AS log_seed,
         2.0::DOUBLE + hybrid * 0.35::DOUBLE + tenure * 0.10::DOUBLE + oxen * 0.20::DOUBLE
           + tractor * 0.15::DOUBLE AS log_v,
         concat_ws(' + ', 'Base', CASE WHEN hybrid = 1 THEN 'Hybrid' END, CASE WHEN tenure = 1 THEN 'Tenure' END,
                   CASE WHEN oxen = 1 THEN 'Oxen' END, CASE WHEN tractor = 1 THEN 'Tractor' END) AS label
  FROM plots p JOIN inputs i ON p.farm_id = i.farm_id)"""


DISTRICT_SQL = (
    FARMS_SQL
    + """,
dfarms AS (SELECT f.*, c.c_nationkey AS district FROM farms f JOIN customer c ON f.hhid = c.c_custkey)"""
)


def daily_quotes(spark: SparkSession, d: str, entity: str = "event_type", alias: str = "market") -> DataFrame:
    """Mean quote per market and day."""
    events = table(spark, d, "events").withColumnRenamed(entity, alias)
    return period_series(events, alias, F.to_date("ts"), "value")


DAILY_SQL = """
daily AS (
  SELECT event_type AS market, CAST(ts AS DATE) AS date, avg(value) AS price
  FROM events GROUP BY event_type, CAST(ts AS DATE))"""

USER_DAILY_SQL = """
daily AS (
  SELECT user_id AS trader, CAST(ts AS DATE) AS date, avg(value) AS price
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""


def monthly_prices(spark: SparkSession, d: str) -> DataFrame:
    """Mean order value per market (priority) and month, a multi-year series."""
    orders = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "market")
    return period_series(orders, "market", F.trunc("o_orderdate", "month"), "o_totalprice")


MONTHLY_SQL = """
monthly AS (
  SELECT o_orderpriority AS market, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS price
  FROM orders GROUP BY 1, 2)"""


def day_text(c: str):
    return F.date_format(c, "yyyy-MM-dd")
