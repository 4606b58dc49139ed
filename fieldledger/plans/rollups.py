"""Join and aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldledger.functions import rounded
from fieldledger.operators import aggregate as A
from fieldledger.operators import joins as J
from fieldledger.operators.columns import missing_profile, transform_columns
from fieldledger.plans.registry import query, rnd
from fieldledger.plans.survey import GAPS_SQL, gaps
from fieldledger.plans.views import DISTRICT_SQL, FARMS_SQL, farms, farms_by_district, table


def homes(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("hhid"),
        F.col("c_nationkey").alias("dist"),
        F.col("c_mktsegment").alias("zone"),
        F.col("c_acctbal").alias("balance"),
    )


def plot_totals(spark, d):
    """Orders summed per household, so that the join below meets one row per key."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("hhid")).agg(
        F.count(F.lit(1)).alias("n_plots"), F.sum("o_totalprice").alias("harvest")
    )


@query(
    "inner_join_keys",
    f"""WITH a AS (SELECT l_partkey AS part, l_suppkey AS supp, sum(l_quantity) AS kg FROM lineitem GROUP BY 1, 2),
        b AS (SELECT l_partkey AS part, l_suppkey AS supp, sum(l_extendedprice) AS kes FROM lineitem
              WHERE l_returnflag = 'R' GROUP BY 1, 2)
        SELECT a.part, a.supp, {rnd("kg", 2)} AS kg, {rnd("kes", 2)} AS kes FROM a JOIN b
        ON a.part = b.part AND a.supp = b.supp""",
)
def inner_join_keys(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_quantity", "l_extendedprice", "l_returnflag"
    )
    keys = ["part", "supp"]
    a = rows.groupBy(*keys).agg(F.sum("l_quantity").alias("kg"))
    b = rows.filter(F.col("l_returnflag") == "R").groupBy(*keys).agg(F.sum("l_extendedprice").alias("kes"))
    return transform_columns(J.join_on(a, b, keys), ["kg", "kes"], lambda c: rounded(c, 2))


@query(
    "natural_join",
    """SELECT n.n_regionkey AS regionkey, n.n_nationkey AS dist, n.n_name AS dist_name, r.r_name AS region_name
       FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
)
def natural_join(spark, d):
    nation = table(spark, d, "nation").toDF("dist", "dist_name", "regionkey")
    return J.natural_join(nation, table(spark, d, "region").toDF("regionkey", "region_name"))


@query(
    "left_join_chain",
    f"""WITH t AS (SELECT o_custkey AS hhid, count(*) AS n_plots, sum(o_totalprice) AS harvest FROM orders GROUP BY 1),
        s AS (SELECT s_nationkey AS dist, count(*) AS n_shops FROM supplier GROUP BY 1),
        u AS (SELECT user_id AS hhid, avg(value) AS mean_quote FROM events GROUP BY 1)
        SELECT c.c_custkey AS hhid, c.c_nationkey AS dist, n.n_name AS dist_name, CAST(n_plots AS BIGINT) AS n_plots,
        {rnd("harvest", 2)} AS harvest, CAST(n_shops AS BIGINT) AS n_shops, {rnd("mean_quote", 6)} AS mean_quote
        FROM customer c LEFT JOIN t ON c.c_custkey = t.hhid LEFT JOIN s ON c.c_nationkey = s.dist
        LEFT JOIN u ON c.c_custkey = u.hhid LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
)
def left_join_chain(spark, d):
    shops = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("dist")).agg(
        F.count(F.lit(1)).alias("n_shops")
    )
    quotes = table(spark, d, "events").groupBy(F.col("user_id").alias("hhid")).agg(F.avg("value").alias("mean_quote"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("dist"), F.col("n_name").alias("dist_name"))
    wide = J.left_join_chain(
        homes(spark, d).select("hhid", "dist"), [plot_totals(spark, d), shops, quotes, names]
    )
    return wide.select(
        "hhid",
        "dist",
        "dist_name",
        "n_plots",
        rounded("harvest", 2).alias("harvest"),
        "n_shops",
        rounded("mean_quote", 6).alias("mean_quote"),
    )


@query(
    "broadcast_dim_join",
    f"""WITH p AS (SELECT s_nationkey AS dist, avg(s_acctbal) AS price FROM supplier GROUP BY 1)
        SELECT c.c_custkey AS hhid, c.c_nationkey AS dist, {rnd("p.price", 6)} AS price,
        {rnd("c.c_acctbal * p.price", 2)} AS worth FROM customer c JOIN p ON c.c_nationkey = p.dist""",
)
def broadcast_dim_join(spark, d):
    prices = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("dist")).agg(F.avg("s_acctbal").alias("price"))
    joined = J.dimension_join(homes(spark, d), prices, ["dist"])
    return joined.select(
        "hhid",
        "dist",
        rounded("price", 6).alias("price"),
        rounded(F.col("balance") * F.col("price"), 2).alias("worth"),
    )


@query(
    "skewed_dim_join",
    f"""SELECT l.l_returnflag AS flag, n.n_name AS dist_name, CAST(count(*) AS BIGINT) AS n,
        {rnd("sum(l.l_quantity * s.s_acctbal) / sum(l.l_quantity)", 4)} AS weighted_balance
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
        GROUP BY 1, 2""",
)
def skewed_dim_join(spark, d):
    """Line items joined to suppliers with hot suppliers salted, whatever the size of either side."""
    shops = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dist_name"))
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), F.col("l_returnflag").alias("flag"), "l_quantity", "l_orderkey"
    )
    joined = J.salted_join(rows, shops, ["s_suppkey"])
    sums = joined.groupBy("flag", "s_nationkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_quantity") * F.col("s_acctbal")).alias("num"),
        F.sum("l_quantity").alias("den"),
    )
    return sums.join(names, "s_nationkey").select(
        "flag", "dist_name", "n", rounded(F.col("num") / F.col("den"), 4).alias("weighted_balance")
    )


MARKET_YEAR_SQL = """
my AS (
  SELECT o_custkey AS market, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon,
         avg(o_totalprice) AS price FROM orders GROUP BY 1, 2, 3)"""


def market_months(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("market"), F.year(day).alias("yr"), F.month(day).alias("mon")
    ).agg(F.avg("o_totalprice").alias("price"))


@query(
    "anti_join_fallback",
    f"""WITH {MARKET_YEAR_SQL} SELECT market, yr, {rnd("avg(price)", 4)} AS p0 FROM my a WHERE mon BETWEEN 2 AND 4
        AND NOT EXISTS (SELECT 1 FROM my b WHERE b.market = a.market AND b.yr = a.yr AND b.mon = 3)
        GROUP BY market, yr""",
)
def anti_join_fallback(spark, d):
    months = market_months(spark, d).filter(F.col("mon").between(2, 4))
    without = J.anti_join(months, months.filter(F.col("mon") == 3), ["market", "yr"])
    return without.groupBy("market", "yr").agg(rounded(F.avg("price"), 4).alias("p0"))


@query(
    "semi_join",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
       (SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING')""",
)
def semi_join(spark, d):
    rich = table(spark, d, "customer").filter((F.col("c_acctbal") > 5000) & (F.col("c_mktsegment") == "BUILDING"))
    plots = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return J.semi_join(plots, rich.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query(
    "group_sum_safe",
    f"""WITH {GAPS_SQL} SELECT c_nationkey AS dist, {rnd("coalesce(sum(urgent), 0)", 2)} AS urgent,
        {rnd("coalesce(sum(high), 0)", 2)} AS high FROM gaps JOIN customer ON c_custkey = hhid GROUP BY c_nationkey""",
)
def group_sum_safe(spark, d):
    rows = gaps(spark, d).join(homes(spark, d).select("hhid", "dist"), "hhid")
    return transform_columns(A.group_sum(rows, ["dist"], ["urgent", "high"]), ["urgent", "high"], lambda c: rounded(c, 2))


@query(
    "group_mean",
    f"""WITH {GAPS_SQL}, m AS (SELECT c_nationkey AS dist, c_mktsegment AS zone, avg(high) AS high FROM gaps
        JOIN customer ON c_custkey = hhid GROUP BY 1, 2)
        SELECT dist, zone, {rnd("high", 4)} AS high FROM m WHERE high IS NOT NULL""",
)
def group_mean(spark, d):
    rows = gaps(spark, d).join(homes(spark, d).select("hhid", "dist", "zone"), "hhid")
    return A.group_mean(rows, ["dist", "zone"], ["high"], drop_missing=True).withColumn("high", rounded("high", 4))


@query(
    "summarise_all",
    f"""SELECT l_suppkey, {rnd("avg(l_quantity)", 6)} AS l_quantity, {rnd("avg(l_extendedprice)", 4)} AS l_extendedprice,
        {rnd("avg(l_discount)", 8)} AS l_discount, {rnd("avg(l_tax)", 8)} AS l_tax FROM lineitem GROUP BY l_suppkey""",
)
def summarise_all(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = A.summarise_all(rows, ["l_suppkey"], F.avg)
    digits = {"l_quantity": 6, "l_extendedprice": 4, "l_discount": 8, "l_tax": 8}
    return out.withColumns({c: rounded(c, n) for c, n in digits.items()})


@query(
    "mixed_rollup",
    f"""WITH {FARMS_SQL} SELECT hhid, {rnd("sum(harvest_kg)", 2)} AS harvest_kg, {rnd("sum(seed_kg)", 2)} AS seed_kg,
        {rnd("sum(area)", 2)} AS area, {rnd("avg(hybrid)", 6)} AS hybrid, {rnd("avg(tenure)", 6)} AS tenure
        FROM farms GROUP BY hhid""",
)
def mixed_rollup(spark, d):
    out = A.mixed_rollup(farms(spark, d), ["hhid"], ["harvest_kg", "seed_kg", "area"], ["hybrid", "tenure"])
    return out.withColumns(
        {
            **{c: rounded(c, 2) for c in ("harvest_kg", "seed_kg", "area")},
            **{c: rounded(c, 6) for c in ("hybrid", "tenure")},
        }
    )


@query(
    "two_level_rollup",
    f"""WITH {DISTRICT_SQL}, hh AS (SELECT district, hhid, sum(harvest_kg) AS harvest, max(hybrid) AS hybrid, sum(area) AS area
        FROM dfarms GROUP BY 1, 2)
        SELECT district, CAST(count(*) AS BIGINT) AS n_hh, {rnd("avg(harvest / area)", 4)} AS mean_yield,
        {rnd("avg(hybrid)", 6)} AS adoption FROM hh GROUP BY district""",
)
def two_level_rollup(spark, d):
    per_hh = farms_by_district(spark, d).groupBy("district", "hhid").agg(
        F.sum("harvest_kg").alias("harvest"), F.max("hybrid").alias("hybrid"), F.sum("area").alias("area")
    )
    return per_hh.groupBy("district").agg(
        F.count(F.lit(1)).alias("n_hh"),
        rounded(F.avg(F.col("harvest") / F.col("area")), 4).alias("mean_yield"),
        rounded(F.avg("hybrid"), 6).alias("adoption"),
    )


@query(
    "global_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS n, {rnd("sum(l_quantity)", 2)} AS kg, {rnd("avg(l_extendedprice)", 4)} AS mean_kes,
        {rnd("stddev_samp(l_discount)", 8)} AS sd_discount FROM lineitem""",
)
def global_summary(spark, d):
    return table(spark, d, "lineitem").agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.sum("l_quantity"), 2).alias("kg"),
        rounded(F.avg("l_extendedprice"), 4).alias("mean_kes"),
        rounded(F.stddev_samp("l_discount"), 8).alias("sd_discount"),
    )


FERT_SQL = """
fert AS (
  SELECT p_type AS kind, l_returnflag AS harvest, sum(l_quantity) AS kg, sum(l_extendedprice) AS kes
  FROM (SELECT l_partkey, l_returnflag, sum(l_quantity) AS l_quantity, sum(l_extendedprice) AS l_extendedprice
        FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def fert(spark, d):
    """Applications summed per input and harvest before the join to the input's kind."""
    used = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("harvest")).agg(
        F.sum("l_quantity").alias("kg"), F.sum("l_extendedprice").alias("kes")
    )
    kinds = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("kind"))
    return used.join(kinds, "l_partkey")


@query(
    "ratio_of_sums",
    f"""WITH {FERT_SQL} SELECT kind, {rnd("sum(kes)", 2)} AS kes, {rnd("sum(kg)", 2)} AS kg,
        {rnd("sum(kes) / nullif(sum(kg), 0)", 6)} AS price FROM fert GROUP BY kind""",
)
def ratio_of_sums(spark, d):
    out = A.ratio_of_sums(fert(spark, d), ["kind"], "kes", "kg", "price")
    return out.select("kind", rounded("kes", 2).alias("kes"), rounded("kg", 2).alias("kg"), rounded("price", 6).alias("price"))


@query(
    "subtotal_rows",
    f"""WITH {FERT_SQL} SELECT harvest, kind, {rnd("sum(kg)", 2)} AS kg, {rnd("sum(kes)", 2)} AS kes FROM
        (SELECT harvest, kind, kg, kes FROM fert UNION ALL SELECT harvest, 'Total synth fert', kg, kes FROM fert)
        GROUP BY harvest, kind""",
)
def subtotal_rows(spark, d):
    out = A.with_subtotal(fert(spark, d), ["harvest"], "kind", ["kg", "kes"], "Total synth fert")
    return transform_columns(out, ["kg", "kes"], lambda c: rounded(c, 2))


@query(
    "group_share",
    f"""WITH {FARMS_SQL} SELECT label, CAST(count(*) AS BIGINT) AS n,
        {rnd("100.0 * count(*) / (SELECT count(*) FROM farms)", 6)} AS pct FROM farms GROUP BY label""",
)
def group_share(spark, d):
    out = A.group_share(farms(spark, d), ["label"])
    return out.select("label", "n", rounded("pct", 6).alias("pct"))


@query(
    "condition_rate",
    f"""WITH {DISTRICT_SQL} SELECT district, {rnd("avg(CASE WHEN harvest_kg * 0.3 > cost_kes THEN 1.0 ELSE 0.0 END)", 6)} AS rate
        FROM dfarms GROUP BY district""",
)
def condition_rate(spark, d):
    profitable = F.col("harvest_kg") * 0.3 > F.col("cost_kes")
    out = A.condition_rate(farms_by_district(spark, d), ["district"], profitable)
    return out.withColumn("rate", rounded("rate", 6))


@query(
    "missing_profile",
    f"""WITH {GAPS_SQL} SELECT 'hhid' AS column_name, CAST(count(*) - count(hhid) AS BIGINT) AS n_missing FROM gaps
        UNION ALL SELECT 'urgent', count(*) - count(urgent) FROM gaps
        UNION ALL SELECT 'high', count(*) - count(high) FROM gaps
        UNION ALL SELECT 'low', count(*) - count(low) FROM gaps""",
)
def missing_profile_query(spark, d):
    return missing_profile(gaps(spark, d))


@query(
    "distinct_values",
    """SELECT p_type, CAST(count(DISTINCT p_brand) AS BIGINT) AS n_brand, CAST(count(DISTINCT p_size) AS BIGINT) AS n_size
       FROM part GROUP BY p_type""",
)
def distinct_values(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(
        F.countDistinct("p_brand").alias("n_brand"), F.countDistinct("p_size").alias("n_size")
    )


@query(
    "category_counts",
    """SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""",
)
def category_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "share_of_group",
    f"""WITH s AS (SELECT l_suppkey AS dist, l_returnflag AS kind, sum(l_quantity) AS kg FROM lineitem GROUP BY 1, 2)
        SELECT dist, kind, {rnd("kg", 2)} AS kg, {rnd("100 * kg / nullif(sum(kg) OVER (PARTITION BY dist), 0)", 6)} AS pct
        FROM s""",
)
def share_of_group(spark, d):
    sums = table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("dist"), F.col("l_returnflag").alias("kind")
    ).agg(F.sum("l_quantity").alias("kg"))
    out = A.share_of_group(sums, ["dist"], "kg", "pct")
    return out.select("dist", "kind", rounded("kg", 2).alias("kg"), rounded("pct", 6).alias("pct"))


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey, n_rows FROM (SELECT *, CAST(count(*) OVER
       (PARTITION BY l_orderkey, l_linenumber) AS BIGINT) AS n_rows FROM lineitem) WHERE n_rows > 1""",
)
def duplicate_keys(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return A.duplicate_rows(rows, ["l_orderkey", "l_linenumber"])


@query(
    "largest_cohort",
    """WITH top AS (SELECT p_retailprice AS p FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
       SELECT p_retailprice, p_partkey, p_type FROM part WHERE p_retailprice IN (SELECT p FROM top)""",
)
def largest_cohort(spark, d):
    return A.largest_cohort(table(spark, d, "part").select("p_retailprice", "p_partkey", "p_type"), "p_retailprice")


@query(
    "single_valued",
    """SELECT l_orderkey, min(l_returnflag) AS lowest, max(l_returnflag) AS highest FROM lineitem
       GROUP BY l_orderkey HAVING min(l_returnflag) <> max(l_returnflag)""",
)
def single_valued(spark, d):
    return A.single_valued(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")
