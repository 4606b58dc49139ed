"""Cleaning, recoding and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldledger.functions import (
    endowment_label,
    linear_score,
    list_recode,
    log_positive,
    masked_dot,
    nz,
    ratio,
    rounded,
    row_sum,
    safe_log,
    substring_recode,
    unit_factor,
)
from fieldledger.operators import columns as C
from fieldledger.operators import reshape as R
from fieldledger.operators.regression import cross_ratio, simple_fit
from fieldledger.plans.registry import query, rnd, sql_log, sql_safe_log
from fieldledger.plans.views import FARMS_SQL, LABELS, farms, table
from fieldledger.sources import literal_table, tag_source, union_sources


@query(
    "multi_source_union",
    """SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""",
)
def multi_source_union(spark, d):
    def part(name, key, value):
        tagged = tag_source(spark.read.parquet(f"{d}/{name}.parquet"))
        return tagged.select("source", F.col(key).alias("id"), F.col(value).alias("balance"))

    return union_sources([part("customer", "c_custkey", "c_acctbal"), part("supplier", "s_suppkey", "s_acctbal")])


# Published midseason supply forecasts in million tons, 2006 to 2012.
FORECASTS = [(2006, 2.7), (2007, 2.6), (2008, 2.16), (2009, 1.84), (2010, 2.6), (2011, 2.34), (2012, 2.4)]


@query(
    "join_literals",
    f"""WITH f(yr, forecast) AS (VALUES {", ".join(f"({y - 10}, {v}::DOUBLE)" for y, v in FORECASTS)}),
    s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, sum(o_totalprice) AS total FROM orders GROUP BY 1)
    SELECT s.yr, f.forecast, {rnd("s.total / 1000", 2)} AS total_k FROM s JOIN f ON s.yr = f.yr""",
)
def join_literals(spark, d):
    forecast = literal_table(spark, [(y - 10, v) for y, v in FORECASTS], "yr int, forecast double")
    yearly = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(
        F.sum("o_totalprice").alias("total")
    )
    # the literal table has seven rows
    return yearly.join(F.broadcast(forecast), "yr").select(
        "yr", "forecast", rounded(F.col("total") / 1000, 2).alias("total_k")
    )


@query("project_columns", "SELECT c_nationkey AS dist, c_custkey AS hhid, c_mktsegment AS zone FROM customer")
def project_columns(spark, d):
    dropped = table(spark, d, "customer").drop("c_name", "c_acctbal")
    names = {"c_nationkey": "dist", "c_custkey": "hhid", "c_mktsegment": "zone"}
    return C.project(dropped, ["c_nationkey", "c_custkey", "c_mktsegment"], names)


@query(
    "regex_rename_columns",
    """SELECT p_partkey AS partkey, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size_kg,
              p_retailprice AS price_kes FROM part""",
)
def regex_rename_columns(spark, d):
    rules = [(r"^p_", ""), (r"^retailprice$", "price_kes"), (r"^size$", "size_kg")]
    return C.rename_by_pattern(table(spark, d, "part"), rules)


# Fixed value: exchange rate of the survey year.
KES_PER_USD = 67.32


@query(
    "unit_ratios",
    f"""SELECT l_partkey AS input_id, {rnd("sum(l_extendedprice) / nullif(sum(l_quantity), 0) / 67.32", 6)} AS price_usd_kg,
        {rnd("sum(l_discount) / nullif(sum(l_tax), 0)", 9)} AS discount_to_tax,
        {rnd("sum(l_quantity) / nullif(count(*), 0)", 6)} AS kg_per_use
        FROM lineitem GROUP BY l_partkey""",
)
def unit_ratios(spark, d):
    sums = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("input_id")).agg(
        F.sum("l_extendedprice").alias("kes"),
        F.sum("l_quantity").alias("kg"),
        F.sum("l_discount").alias("disc"),
        F.sum("l_tax").alias("tax"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    return sums.select(
        "input_id",
        rounded(ratio("kes", "kg") / KES_PER_USD, 6).alias("price_usd_kg"),
        rounded(ratio("disc", "tax"), 9).alias("discount_to_tax"),
        rounded(ratio("kg", "n"), 6).alias("kg_per_use"),
    )


@query(
    "filter_conjunction",
    """SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem
       WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND l_quantity > 25""",
)
def filter_conjunction(spark, d):
    keep = F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25)
    return table(spark, d, "lineitem").filter(keep).select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")


@query(
    "filter_exclusion",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
       WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_totalprice IS NOT NULL
         AND o_orderdate > DATE '1997-11-01' AND o_orderdate < DATE '1999-04-15'""",
)
def filter_exclusion(spark, d):
    day = F.col("o_orderdate")
    keep = (
        ~F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
        & F.col("o_totalprice").isNotNull()
        & (day > F.lit("1997-11-01").cast("timestamp_ntz"))
        & (day < F.lit("1999-04-15").cast("timestamp_ntz"))
    )
    return table(spark, d, "orders").filter(keep).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "per_unit_scaling",
    f"""WITH {FARMS_SQL} SELECT farm_id, area, {rnd("seed_kg / area", 6)} AS seed_kg_acre,
        {rnd("harvest_kg / area", 6)} AS harvest_kg_acre, {rnd("cost_kes / area", 6)} AS cost_kes_acre FROM farms""",
)
def per_unit_scaling(spark, d):
    wide = farms(spark, d).select("farm_id", "area", "seed_kg", "harvest_kg", "cost_kes")
    scaled = C.scale_columns(wide, r"_(kg|kes)$", "area", "_acre")
    return C.transform_columns(scaled, C.matching(scaled, r"_acre$"), lambda c: rounded(c, 6))


@query(
    "conditional_recode",
    f"""SELECT l_suppkey AS dist,
        {rnd("sum(CASE WHEN l_returnflag = 'N' THEN l_quantity * 0.85::DOUBLE ELSE l_quantity END)", 4)} AS kg_dry,
        CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_adopter
        FROM lineitem GROUP BY l_suppkey""",
)
def conditional_recode(spark, d):
    dry = F.when(F.col("l_returnflag") == "N", F.col("l_quantity") * 0.85).otherwise(F.col("l_quantity"))
    adopter = F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("dist"), dry.alias("kg"), adopter.alias("adopter")
    )
    return rows.groupBy("dist").agg(
        rounded(F.sum("kg"), 4).alias("kg_dry"), F.sum("adopter").alias("n_adopter")
    )


@query(
    "category_rollup",
    f"""WITH r AS (SELECT CASE WHEN p_type LIKE '%LARGE%' OR p_type LIKE '%MEDIUM%' THEN 'Total bulk'
          WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'other' ELSE p_type END AS kind, p_retailprice FROM part)
        SELECT kind, CAST(count(*) AS BIGINT) AS n, {rnd("avg(p_retailprice)", 6)} AS mean_price FROM r GROUP BY kind""",
)
def category_rollup(spark, d):
    kind = substring_recode("p_type", [("LARGE", "Total bulk"), ("MEDIUM", "Total bulk")])
    kind = list_recode(kind, ["PROMO", "ECONOMY"], "other")
    return (
        table(spark, d, "part")
        .groupBy(kind.alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("p_retailprice"), 6).alias("mean_price"))
    )


UNITS = ["gram", "gorogoro", "90 kg bag", "litre", "kg", "handful"]


@query(
    "unit_normalize",
    f"""WITH u AS (SELECT CASE l_linenumber WHEN 1 THEN 'gram' WHEN 2 THEN 'gorogoro' WHEN 3 THEN '90 kg bag'
            WHEN 4 THEN 'litre' WHEN 5 THEN 'kg' ELSE 'handful' END AS unit, l_quantity AS qty,
            l_extendedprice AS price FROM lineitem),
        k AS (SELECT *, CASE unit WHEN 'gram' THEN 0.001::DOUBLE WHEN 'gorogoro' THEN 2.0::DOUBLE
            WHEN '90 kg bag' THEN 90.0::DOUBLE ELSE 1.0::DOUBLE END AS f FROM u)
        SELECT unit, CAST(count(*) AS BIGINT) AS n, {rnd("sum(qty * f)", 3)} AS kg, {rnd("avg(price / f)", 3)} AS price_kg
        FROM k GROUP BY unit""",
)
def unit_normalize(spark, d):
    line = F.col("l_linenumber")
    unit = F.lit(UNITS[-1])
    for i, name in reversed(list(enumerate(UNITS[:-1], start=1))):
        unit = F.when(line == i, F.lit(name)).otherwise(unit)
    rows = table(spark, d, "lineitem").select(unit.alias("unit"), "l_quantity", "l_extendedprice")
    f = unit_factor("unit")
    return rows.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.sum(F.col("l_quantity") * f), 3).alias("kg"),
        rounded(F.avg(F.col("l_extendedprice") / f), 3).alias("price_kg"),
    )


# A household table with gaps: spending per priority exists only where such orders exist.
GAPS_SQL = """
spend AS (
  SELECT o_custkey AS hhid, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS urgent,
         sum(CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN o_totalprice END) AS high,
         sum(CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN o_totalprice END) AS low
  FROM orders GROUP BY o_custkey),
gaps AS (
  SELECT c_custkey AS hhid, urgent, high, low FROM customer LEFT JOIN spend ON c_custkey = hhid)"""


def gaps(spark, d):
    prio, status, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    spend = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("hhid")).agg(
        F.sum(F.when(prio == "1-URGENT", price)).alias("urgent"),
        F.sum(F.when((prio == "2-HIGH") & (status == "P"), price)).alias("high"),
        F.sum(F.when((prio == "5-LOW") & (status == "F"), price)).alias("low"),
    )
    homes = table(spark, d, "customer").select(F.col("c_custkey").alias("hhid"))
    return homes.join(spend, "hhid", "left")


@query(
    "fill_missing",
    f"""WITH {GAPS_SQL} SELECT hhid, {rnd("CASE WHEN urgent IS NULL THEN 0.0 ELSE urgent END", 2)} AS urgent,
        {rnd("CASE WHEN urgent IS NULL THEN 0.0 ELSE high END", 2)} AS high, {rnd("coalesce(low, 0)", 2)} AS low
        FROM gaps""",
)
def fill_missing(spark, d):
    filled = C.fill_missing(C.fill_block(gaps(spark, d), "urgent", ["urgent", "high"]), ["low"])
    return C.transform_columns(filled, ["urgent", "high", "low"], lambda c: rounded(c, 2))


@query(
    "safe_log",
    f"""SELECT c_custkey AS hhid, {rnd(sql_safe_log("c_acctbal"), 6)} AS log_balance,
        {rnd(sql_safe_log("greatest(c_acctbal, 0)"), 6)} AS log_floor FROM customer""",
)
def safe_log_query(spark, d):
    floor = F.greatest(F.col("c_acctbal"), F.lit(0.0))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("hhid"),
        rounded(safe_log("c_acctbal"), 6).alias("log_balance"),
        rounded(safe_log(floor), 6).alias("log_floor"),
    )


@query(
    "drop_missing",
    f"""WITH {GAPS_SQL} SELECT 'any' AS rule, hhid, {rnd("urgent + high + low", 2)} AS total FROM gaps
        WHERE urgent IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL
        UNION ALL SELECT 'high' AS rule, hhid, {rnd("high", 2)} FROM gaps WHERE high IS NOT NULL""",
)
def drop_missing(spark, d):
    data = gaps(spark, d)
    total = F.col("urgent") + F.col("high") + F.col("low")
    whole = C.drop_missing(data).select(F.lit("any").alias("rule"), "hhid", rounded(total, 2).alias("total"))
    some = C.drop_missing(data, ["high"]).select(F.lit("high").alias("rule"), "hhid", rounded("high", 2).alias("total"))
    return R.union_all([whole, some])


@query(
    "outlier_rules",
    f"""WITH {FARMS_SQL} SELECT farm_id, {rnd("cost", 6)} AS cost, oxen, tractor FROM farms
        WHERE NOT (cost > 90000) AND NOT (oxen + hybrid + tenure = 3) AND NOT (harvest_kg = 76500)""",
)
def outlier_rules(spark, d):
    kept = C.drop_where(
        farms(spark, d),
        F.col("cost") > 90000,
        F.col("oxen") + F.col("hybrid") + F.col("tenure") == 3,
        F.col("harvest_kg") == 76500,
    )
    return kept.select("farm_id", rounded("cost", 6).alias("cost"), "oxen", "tractor")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "dummy_columns",
    "SELECT c_custkey, "
    + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s.lower()}" for s in SEGMENTS)
    + " FROM customer",
)
def dummy_columns(spark, d):
    return C.dummy_columns(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), {"c_mktsegment": SEGMENTS})


@query("level_rows", "SELECT c_custkey, 'c_mktsegment' AS \"column\", c_mktsegment AS level, 1 AS flag FROM customer WHERE c_mktsegment IS NOT NULL")
def level_rows(spark, d):
    return C.level_rows(table(spark, d, "customer"), "c_custkey", ["c_mktsegment"])


@query(
    "threshold_dummies",
    f"""WITH {FARMS_SQL}, m AS (SELECT hhid, avg(hybrid) AS hybrid, avg(tenure) AS tenure, avg(oxen) AS oxen
        FROM farms GROUP BY hhid)
        SELECT hhid, CAST(hybrid >= 0.15::DOUBLE AS INTEGER) AS hybrid, CAST(tenure >= 0.15::DOUBLE AS INTEGER) AS tenure,
        CAST(oxen >= 0.15::DOUBLE AS INTEGER) AS oxen FROM m""",
)
def threshold_dummies(spark, d):
    flags = ["hybrid", "tenure", "oxen"]
    shares = farms(spark, d).groupBy("hhid").agg(*[F.avg(c).alias(c) for c in flags])
    return C.threshold_flags(shares, flags, 0.15)


@query(
    "row_sum_columns",
    f"""WITH {GAPS_SQL} SELECT hhid, {rnd("coalesce(urgent, 0) + coalesce(high, 0) + coalesce(low, 0)", 2)} AS total
        FROM gaps""",
)
def row_sum_columns(spark, d):
    return gaps(spark, d).select("hhid", rounded(row_sum(["urgent", "high", "low"]), 2).alias("total"))


USE_COEFS = {"a_kg": 0.05, "n_kg": 0.08, "r_kg": 0.12}
USE_SQL = """
use AS (
  SELECT l_orderkey AS farm_id, coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS a_kg,
         coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) AS n_kg,
         coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS r_kg
  FROM lineitem GROUP BY l_orderkey)"""


def input_use(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "farm_id")
    wide = R.pivot_wide(rows, ["farm_id"], "l_returnflag", ["A", "N", "R"], "l_quantity", "_kg")
    return wide.withColumnsRenamed({"A_kg": "a_kg", "N_kg": "n_kg", "R_kg": "r_kg"})


@query(
    "masked_dot_product",
    f"""WITH {USE_SQL} SELECT farm_id, {rnd('''(CASE WHEN a_kg <> 0 THEN 0.05::DOUBLE ELSE 0 END)
        + (CASE WHEN n_kg <> 0 THEN 0.08::DOUBLE ELSE 0 END) + (CASE WHEN r_kg <> 0 THEN 0.12::DOUBLE ELSE 0 END)''', 6)} AS h
        FROM use""",
)
def masked_dot_product(spark, d):
    return input_use(spark, d).select("farm_id", rounded(masked_dot(USE_COEFS), 6).alias("h"))


@query(
    "linear_score",
    f"""WITH {FARMS_SQL} SELECT farm_id,
        {rnd("2.0::DOUBLE + hybrid * 0.35::DOUBLE + log_area * -0.2::DOUBLE + log_seed * 0.1::DOUBLE", 6)} AS score
        FROM farms""",
)
def linear_score_query(spark, d):
    score = linear_score({"hybrid": 0.35, "log_area": -0.2, "log_seed": 0.1}, 2.0)
    return farms(spark, d).select("farm_id", rounded(score, 6).alias("score"))


@query("endowment_label", f"WITH {FARMS_SQL} SELECT farm_id, label FROM farms")
def endowment_label_query(spark, d):
    return farms(spark, d).drop("label").select("farm_id", endowment_label(LABELS).alias("label"))


STATUS = ["F", "O", "P"]


@query(
    "pivot_wide",
    "SELECT o_custkey AS hhid, "
    + ", ".join(
        f"{rnd(f'''coalesce(sum(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 0)''', 2)} AS {s}_kes"
        for s in STATUS
    )
    + " FROM orders GROUP BY o_custkey",
)
def pivot_wide(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_custkey", "hhid")
    wide = R.pivot_wide(rows, ["hhid"], "o_orderstatus", STATUS, "o_totalprice", "_kes")
    return C.transform_columns(wide, [f"{s}_kes" for s in STATUS], lambda c: rounded(c, 2))


@query(
    "unpivot_long",
    """SELECT p_partkey AS id, 'size' AS variable, CAST(p_size AS DOUBLE) AS val FROM part
       UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""",
)
def unpivot_long(spark, d):
    wide = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")
    )
    return R.unpivot_long(wide, ["id"], ["size", "price"])


FLAGS = ["A", "N", "R"]
LABOUR_SQL = "labour AS (SELECT l_suppkey AS dist, " + ", ".join(
    f"coalesce(sum(CASE WHEN l_returnflag = '{v}' THEN {e} END), 0) AS {v}_{m}"
    for v in FLAGS
    for m, e in (("kg", "l_quantity"), ("kes", "l_extendedprice"))
) + " FROM lineitem GROUP BY l_suppkey)"


def labour_wide(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("dist"),
        "l_returnflag",
        F.col("l_quantity").alias("kg"),
        F.col("l_extendedprice").alias("kes"),
    )
    return R.pivot_measures(rows, ["dist"], "l_returnflag", FLAGS, ["kg", "kes"])


@query(
    "pivot_multi_measure",
    f"WITH {LABOUR_SQL} SELECT dist, "
    + ", ".join(f"{rnd(f'{v}_{m}', 2)} AS {v}_{m}" for v in FLAGS for m in ("kg", "kes"))
    + f", {rnd('A_kg + N_kg + R_kg', 2)} AS total_kg, {rnd('A_kes + N_kes + R_kes', 2)} AS total_kes FROM labour",
)
def pivot_multi_measure(spark, d):
    wide = labour_wide(spark, d)
    return C.transform_columns(wide, C.matching(wide, "_(kg|kes)$"), lambda c: rounded(c, 2))


@query(
    "price_from_cost_qty",
    f"WITH {LABOUR_SQL} SELECT dist, "
    + ", ".join(f"{rnd(f'{v}_kes / nullif({v}_kg, 0)', 6)} AS {v}_price" for v in FLAGS)
    + f", {rnd('(A_kes + N_kes + R_kes) / nullif(A_kg + N_kg + R_kg, 0)', 6)} AS total_price FROM labour",
)
def price_from_cost_qty(spark, d):
    prices = R.unit_prices(labour_wide(spark, d), ["dist"], FLAGS, "kes", "kg")
    return C.transform_columns(prices, C.matching(prices, "_price$"), lambda c: rounded(c, 6))


@query(
    "activity_totals",
    f"""SELECT l_returnflag AS activity, 'kg' AS measure, {rnd("coalesce(sum(l_quantity), 0)", 2)} AS qty
        FROM lineitem GROUP BY l_returnflag
        UNION ALL SELECT l_returnflag, 'kes', {rnd("coalesce(sum(l_extendedprice), 0)", 2)} FROM lineitem
        GROUP BY l_returnflag""",
)
def activity_totals(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("activity"), F.col("l_quantity").alias("kg"), F.col("l_extendedprice").alias("kes")
    )
    return R.activity_totals(rows, "activity", ["kg", "kes"]).withColumn("qty", rounded("qty", 2))


@query(
    "union_all",
    """SELECT c_nationkey AS dist, c_acctbal AS balance FROM customer
       UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""",
)
def union_all(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("dist"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("dist"))
    return R.union_all([a, b])


LONG_PRICE_SQL = """
long AS (
  SELECT c_nationkey AS dist, 'wage' AS item, avg(c_acctbal) AS value FROM customer GROUP BY c_nationkey
  UNION ALL SELECT s_nationkey, 'seed', avg(s_acctbal) FROM supplier GROUP BY s_nationkey
  UNION ALL SELECT c_nationkey, 'maize', max(c_acctbal) FROM customer GROUP BY c_nationkey)"""


def long_prices(spark, d):
    cust = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("dist")).agg(
        F.avg("c_acctbal").alias("wage"), F.max("c_acctbal").alias("maize")
    )
    seed = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("dist")).agg(
        F.avg("s_acctbal").alias("price")
    )
    wage = cust.select("dist", F.col("wage").alias("price"))
    maize = cust.select("dist", F.col("maize").alias("price"))
    return R.stack_items({"wage": wage, "seed": seed, "maize": maize}, "dist", "price")


@query("price_long_table", f"WITH {LONG_PRICE_SQL} SELECT dist, item, {rnd('value', 6)} AS value FROM long")
def price_long_table(spark, d):
    return long_prices(spark, d).withColumn("value", rounded("value", 6))


@query(
    "price_vector_lookup",
    f"""WITH {LONG_PRICE_SQL} SELECT dist, {rnd("max(CASE WHEN item = 'maize' THEN value END)", 6)} AS p,
        {rnd("max(CASE WHEN item = 'wage' THEN value END)", 6)} AS w_labour,
        {rnd("max(CASE WHEN item = 'seed' THEN value END)", 6)} AS w_seed FROM long GROUP BY dist""",
)
def price_vector_lookup(spark, d):
    wide = R.item_vector(long_prices(spark, d), ["dist"], {"maize": "p", "wage": "w_labour", "seed": "w_seed"})
    return C.transform_columns(wide, ["p", "w_labour", "w_seed"], lambda c: rounded(c, 6))


@query(
    "except_keys",
    """SELECT 'only_a' AS part, k AS key FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders
         WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
       UNION ALL SELECT 'both', k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders
         WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""",
)
def except_keys(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    b = table(spark, d, "orders").filter(urgent).select(F.col("o_custkey").alias("key"))
    only = a.subtract(b).select(F.lit("only_a").alias("part"), "key")
    both = a.intersect(b).select(F.lit("both").alias("part"), "key")
    return R.union_all([only, both])


@query(
    "composite_cost",
    f"""WITH {FARMS_SQL} SELECT farm_id,
        {rnd("(cost_kes + coalesce(seed_kg * 12.5::DOUBLE, 0) + 900.0) / area", 6)} AS composite_cost,
        {rnd("harvest_kg / area * 18.0", 6)} AS revenue FROM farms""",
)
def composite_cost(spark, d):
    parts = farms(spark, d).withColumns({"seed_cost": F.col("seed_kg") * 12.5, "land_prep": F.lit(900.0)})
    total = row_sum(["cost_kes", "seed_cost", "land_prep"])
    return parts.select(
        "farm_id",
        rounded(total / F.col("area"), 6).alias("composite_cost"),
        rounded(F.col("yield") * 18.0, 6).alias("revenue"),
    )


@query(
    "expenditure_shares",
    f"""WITH {LABOUR_SQL}, t AS (SELECT *, A_kes + N_kes + R_kes AS total FROM labour)
        SELECT dist, 'A_kes' AS input, {rnd("A_kes / nullif(total, 0)", 8)} AS share FROM t
        UNION ALL SELECT dist, 'N_kes', {rnd("N_kes / nullif(total, 0)", 8)} FROM t
        UNION ALL SELECT dist, 'R_kes', {rnd("R_kes / nullif(total, 0)", 8)} FROM t""",
)
def expenditure_shares(spark, d):
    wide = labour_wide(spark, d)
    costs = ["A_kes", "N_kes", "R_kes"]
    shares = wide.select("dist", *[ratio(nz(c), row_sum(costs)).alias(c) for c in costs])
    return R.unpivot_long(shares, ["dist"], costs, "input", "share").withColumn("share", rounded("share", 8))


@query(
    "share_cost_fit",
    f"WITH {LABOUR_SQL}, t AS (SELECT *, A_kes + N_kes + R_kes AS total FROM labour), l AS ("
    + " UNION ALL ".join(
        f"SELECT '{v}_kes' AS input, {sql_log('total')} AS log_total, {sql_log(f'{v}_kes')} AS log_cost FROM t"
        for v in FLAGS
    )
    + f""") SELECT input, CAST(count(*) AS BIGINT) AS n, {rnd("regr_slope(log_total, log_cost)", 6)} AS slope,
        {rnd("regr_intercept(log_total, log_cost)", 6)} AS intercept FROM l
        WHERE log_total IS NOT NULL AND log_cost IS NOT NULL GROUP BY input""",
)
def share_cost_fit(spark, d):
    """Total expenditure against the expenditure on each input, in logs, one fit per input."""
    costs = ["A_kes", "N_kes", "R_kes"]
    wide = labour_wide(spark, d).withColumn("total", row_sum(costs))
    long = R.unpivot_long(wide, ["dist", "total"], costs, "input", "cost")
    logs = long.select("input", log_positive("total").alias("log_total"), log_positive("cost").alias("log_cost"))
    fit = simple_fit(logs, "log_total", "log_cost", ["input"])
    return fit.select("input", "n", rounded("slope", 6).alias("slope"), rounded("intercept", 6).alias("intercept"))


RATIOS = [("A_kes", "N_kes"), ("A_kes", "R_kes"), ("N_kes", "R_kes")]


@query(
    "share_ratio_check",
    f"WITH {LABOUR_SQL}, costs AS (SELECT A_kes / 0.05::DOUBLE AS A_kes, N_kes / 0.08::DOUBLE AS N_kes, "
    "R_kes / 0.12::DOUBLE AS R_kes FROM labour), r AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}/{b}' AS pair, {sql_log(a)} - {sql_log(b)} AS x FROM costs" for a, b in RATIOS
    )
    + f") SELECT pair, CAST(count(x) AS BIGINT) AS n, {rnd('avg(x)', 6)} AS mean, {rnd('stddev_samp(x)', 6)} AS sd "
    "FROM r GROUP BY pair",
)
def share_ratio_check(spark, d):
    coefs = {"A_kes": 0.05, "N_kes": 0.08, "R_kes": 0.12}
    scaled = labour_wide(spark, d).withColumns({c: F.col(c) / F.lit(a) for c, a in coefs.items()})
    out = cross_ratio(scaled, RATIOS)
    return C.transform_columns(out, ["mean", "sd"], lambda c: rounded(c, 6))

