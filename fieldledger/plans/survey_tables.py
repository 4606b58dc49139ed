"""The survey end to end on the given tables: customers are households, orders their fields, line items what was sown and bought."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldledger.functions import rounded
from fieldledger.operators.joins import dimension_join
from fieldledger.operators.lineage import materialise
from fieldledger.plans import farm_etl as E
from fieldledger.plans.registry import query, rnd
from fieldledger.plans.views import table

ACTIVITIES = ["click", "purchase", "view"]
LATER = ["purchase", "view"]
SEED_TYPES = ["purchased new hybrid", "retained", "purchased hybrid & retained"]
SOWN = ["maize-dry", "maize-green", "beans", "wheat"]
FERTILISERS = ["CAN (26:0:0)", "NPK (17:17:17)", "UREA (46:0:0)", "dap", "manure", "NPK+CAN", "DAP + CAN"]
BOUGHT = [*E.PEST_KINDS, "Seed", "Fertilizer"]
UNITS = ["kg", "gram", "litre", "90 kg bag"]


def pick(values: list[str], index: str):
    """The value at a column's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(index) % len(values) + 1).cast("int"))


def survey_tables(spark, d) -> dict:
    """The survey's tables by name, as ``farm_etl.model_table`` takes them."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = nation.select(F.col("n_nationkey").alias("nk"), F.initcap("n_name").alias("dist"), F.initcap("r_name").alias("prov"))
    homes = dimension_join(
        table(spark, d, "customer").select(F.col("c_custkey").alias("hhid"), F.col("c_nationkey").alias("nk"), "c_acctbal"), places, ["nk"]
    )
    orders = table(spark, d, "orders")
    season = F.when(F.month("o_orderdate") <= 9, "main").otherwise("short")
    prep = F.when(F.col("o_orderpriority") == "1-URGENT", "oxen").when(F.col("o_orderpriority") == "3-MEDIUM", "tractor").otherwise("manual")
    field = orders.select(
        F.col("o_custkey").alias("hhid"),
        F.col("o_orderkey").alias("field"),
        season.alias("harvest"),
        F.when(F.col("o_orderstatus") == "F", "owned with title deed").otherwise("rented").alias("tenure"),
        F.when(F.col("o_orderpriority") == "5-LOW", "irrigated (piped)").otherwise("rain").alias("watersrc"),
        prep.alias("landprep"),
        (F.col("o_totalprice") / 100000 + 0.5).alias("acres"),
        (F.col("o_totalprice") / 1000).alias("lpcost"),
    )
    where = dimension_join(orders.select("o_orderkey", F.col("o_custkey").alias("hhid"), season.alias("harvest")), homes, ["hhid"])
    # four of the tables below come from it
    used = materialise(
        table(spark, d, "lineitem")
        .select(F.col("l_orderkey").alias("field"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
        .join(where.select(F.col("o_orderkey").alias("field"), "hhid", "dist", "harvest"), "field")
    )
    crop = used.select(
        "dist",
        "hhid",
        "field",
        pick(SOWN, "l_partkey").alias("crop"),
        "harvest",
        pick(SEED_TYPES, "l_suppkey").alias("sdtype"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity") * 10).alias("kgharv"),
        (F.col("l_quantity") / 10).alias("seedkg"),
        (F.col("l_extendedprice") / 1000).alias("scost"),
    )
    fert = used.select(
        "hhid",
        "field",
        "harvest",
        pick(FERTILISERS, "l_suppkey").alias("ferttype"),
        F.col("l_quantity").alias("fertotal"),
        (F.col("l_extendedprice") / 100).alias("fertcost"),
    )
    inputs = used.select(
        "dist",
        "hhid",
        pick(SOWN, "l_partkey").alias("mcrop"),
        pick(BOUGHT, "l_partkey + l_linenumber").alias("inputype"),
        F.col("l_quantity").alias("numpur"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("inputpr"),
        pick(UNITS, "l_suppkey").alias("punit"),
    )
    labour = table(spark, d, "events").select(
        F.col("user_id").alias("hhid"),
        F.col("event_type").alias("activity"),
        F.expr("double(event_id % 3)").alias("lb01"),
        F.expr("value / 10").alias("lb02"),
        F.expr("80.5D + event_id % 7").alias("lb03"),
        F.expr("double(event_id % 2)").alias("lb05"),
        F.expr("value / 20").alias("lb06"),
        F.expr("double(event_id % 4)").alias("lb07"),
        F.expr("value / 30").alias("lb08"),
        F.expr("CASE WHEN event_id % 5 > 0 THEN 1.0D END").alias("lb09"),
        F.expr("value / 40").alias("lb10"),
    )
    place = [F.lower("prov").alias("prov"), F.lower("dist").alias("dist")]
    members = homes.select(
        "hhid",
        F.explode(F.array(F.lit("head"), F.lit("spouse"))).alias("da03"),
        F.expr("double(20 + hhid % 51)").alias("age"),
        F.expr("CASE WHEN hhid % 3 = 0 THEN 'female' ELSE 'male' END").alias("gend"),
    )
    village = dimension_join(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "nk"), places, ["nk"])
    return {
        "crop": crop,
        "field": field,
        "fert": fert,
        "inputs": inputs,
        "labour": labour,
        "members": members,
        "sizes": homes.filter("hhid % 10 > 0").select("hhid", F.expr("int(1 + hhid % 9)").alias("hhsize")),
        "rain": homes.select("hhid", *place, F.expr("'north ' || hhid % 3").alias("div"), F.expr("600 + c_acctbal / 20").alias("main07")),
        "climate": village.select(
            "prov",
            "dist",
            F.expr("'North ' || s_suppkey % 3").alias("div"),
            F.expr("700 + s_acctbal / 30").alias("qwetpre"),
            F.expr("12 + s_acctbal / 2000").alias("qwetit"),
            F.expr("25 + s_acctbal / 1000").alias("qwetxt"),
        ),
        "crop_price": dimension_join(table(spark, d, "part").withColumn("nk", F.expr("int(p_partkey % 25)")), places, ["nk"])
        .groupBy("dist", F.expr("CASE WHEN p_size % 2 = 0 THEN 'maize' ELSE 'beans' END").alias("crop"))
        .agg((F.avg("p_retailprice") / 50).alias("price_kes_kg")),
    }


def farms(spark, d):
    return E.model_table(**survey_tables(spark, d), activities=ACTIVITIES, later=LATER)


def _pick(values: list[str], index: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({index} AS BIGINT) % {len(values)} + 1]"


def _sums(kinds: dict[str, str], measures: dict[str, str]) -> str:
    return ", ".join(f"coalesce(sum(CASE WHEN {cond} THEN {x} END), 0) AS {k}_{m}" for k, cond in kinds.items() for m, x in measures.items())


_KINDS = [k.lower() for k in E.PEST_KINDS]
_FERT = {
    **{k: f"ferttype ILIKE '{k}%'" for k in E.SYNTHETIC},
    "synth": "ferttype <> 'manure'",
    "manure": "ferttype = 'manure'",
}
_LABOUR = {
    "wage_hours": "lb01 * lb02 * 8",
    "male_hours": "lb05 * lb06",
    "female_hours": "lb07 * lb08",
    "child_hours": "lb09 * lb10",
    "adult_hours": "(lb05 * lb06 + lb07 * lb08)",
    "family_hours": "(lb05 * lb06 + lb07 * lb08 + coalesce(lb09 * lb10, 0))",
    "wage_kes": "lb01 * lb02 * lb03",
}
_ACTS = {**{a: f"activity = '{a}'" for a in ACTIVITIES}, "total": f"activity IN ({', '.join(map(repr, ACTIVITIES))})"}

FARM_SQL = f"""
pl AS (SELECT n_nationkey AS nk, 'Nation' || substr(n_name, 7) AS dist, upper(r_name[1]) || lower(substr(r_name, 2)) AS prov
       FROM nation JOIN region ON n_regionkey = r_regionkey),
hh AS (SELECT c_custkey AS hhid, dist, prov, c_acctbal FROM customer JOIN pl ON c_nationkey = nk),
fl AS (SELECT o_custkey AS hhid, o_orderkey AS field, o_totalprice / 100000 + 0.5 AS acres, o_totalprice / 1000 AS lpcost,
       (o_orderpriority = '5-LOW')::INT AS irrigated, (o_orderstatus = 'F')::INT AS tenure_deed,
       (o_orderpriority = '1-URGENT')::INT AS oxen, (o_orderpriority = '3-MEDIUM')::INT AS tractor
       FROM orders WHERE month(o_orderdate) <= 9),
us AS (SELECT l.*, o_custkey AS hhid, dist, month(o_orderdate) <= 9 AS main, {_pick(SOWN, "l_partkey")} AS sown,
       {_pick(FERTILISERS, "l_suppkey")} AS ferttype, {_pick(BOUGHT, "l_partkey + l_linenumber")} AS bought,
       {_pick(UNITS, "l_suppkey")} AS punit
       FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN hh ON o_custkey = hh.hhid),
cf AS (SELECT dist, hhid, l_orderkey AS field, split_part(sown, '-', 1) AS crop,
       coalesce(sum(CASE WHEN l_discount > 0 THEN l_quantity * 10 * CASE WHEN sown = 'maize-green' THEN 0.85 ELSE 1 END END), 0) AS harvest_kg,
       sum(l_quantity / 10) AS seed_kg, sum(l_extendedprice / 1000) AS seed_kes,
       avg((l_suppkey % 3 <> 1)::INT) AS adopter
       FROM us WHERE main AND sown <> 'wheat' GROUP BY ALL),
ft AS (SELECT hhid, l_orderkey AS field, {_sums(_FERT, {"kg": "l_quantity", "kes": "l_extendedprice / 100"})}
       FROM us WHERE main AND ferttype NOT LIKE '%+%' GROUP BY ALL),
rl AS (SELECT cf.dist, cf.hhid, crop, sum(harvest_kg) AS harvest_kg, sum(seed_kg) AS seed_kg, sum(seed_kes) AS seed_kes,
       sum(acres) AS acres, sum(lpcost) AS lpcost,
       {", ".join(f"sum({k}_{m}) AS {k}_{m}" for k in _FERT for m in ("kg", "kes"))},
       {", ".join(f"(avg({c}) >= 0.15)::INT AS {c}" for c in ("adopter", *E.FIELD_FLAGS))}
       FROM cf JOIN fl ON cf.hhid = fl.hhid AND cf.field = fl.field JOIN ft ON cf.hhid = ft.hhid AND cf.field = ft.field GROUP BY 1, 2, 3),
ac AS (SELECT hhid, sum(acres) AS acres_tot FROM fl GROUP BY 1),
lb AS (SELECT hhid, {_sums(_ACTS, _LABOUR)} FROM (
       SELECT user_id AS hhid, event_type AS activity, (event_id % 3)::DOUBLE AS lb01, value / 10 AS lb02, 80.5 + event_id % 7 AS lb03,
       (event_id % 2)::DOUBLE AS lb05, value / 20 AS lb06, (event_id % 4)::DOUBLE AS lb07, value / 30 AS lb08,
       CASE WHEN event_id % 5 > 0 THEN 1.0 END AS lb09, value / 40 AS lb10 FROM events) GROUP BY 1),
pc AS (SELECT dist, hhid, split_part(sown, '-', 1) AS crop, lower(bought) AS kind, l_quantity * f AS kg,
       l_extendedprice / l_quantity / f AS price
       FROM us JOIN (VALUES ('kg', 1.0::DOUBLE), ('gram', 0.001::DOUBLE), ('litre', 1.0::DOUBLE), ('90 kg bag', 90.0::DOUBLE)) u(punit, f) USING (punit)
       WHERE sown <> 'wheat' AND bought NOT IN ('Seed', 'Fertilizer')),
cw AS (SELECT hhid, crop, {_sums({**{k: f"kind = '{k}'" for k in _KINDS}, "chem": "true"}, {"kg": "kg", "kes": "kg * price"})}
       FROM pc GROUP BY 1, 2),
hp AS (SELECT dist, hhid, crop, kind, avg(price) AS price FROM pc GROUP BY ALL
       UNION ALL SELECT dist, hhid, crop, 'chem', sum(kg * price) / nullif(sum(kg), 0) FROM pc GROUP BY 1, 2, 3),
dp AS (SELECT dist, crop, kind, exp(avg(ln(price)) + pow(stddev_samp(ln(price)), 2) / 2) AS mu FROM hp WHERE price > 0 GROUP BY ALL),
dw AS (SELECT dist, crop, {", ".join(f"max(CASE WHEN kind = '{k}' THEN mu END) AS {k}_price" for k in [*_KINDS, "chem"])}
       FROM dp GROUP BY 1, 2),
cl AS (SELECT prov, dist, s_suppkey % 3 AS div, avg(700 + s_acctbal / 30) AS qwetpre, avg(12 + s_acctbal / 2000) AS qwetit,
       avg(25 + s_acctbal / 1000) AS qwetxt FROM supplier JOIN pl ON s_nationkey = nk GROUP BY ALL),
rn AS (SELECT hhid, 600 + c_acctbal / 20 AS main07, qwetpre, qwetit, qwetxt FROM hh JOIN cl
       ON hh.prov = cl.prov AND hh.dist = cl.dist AND hh.hhid % 3 = cl.div),
hd AS (SELECT hhid, (20 + hhid % 51)::DOUBLE AS head_age, (hhid % 3 = 0)::INT AS head_female, (1 + hhid % 9)::INT AS hhsize FROM hh WHERE hhid % 10 > 0),
cp AS (SELECT dist, CASE WHEN p_size % 2 = 0 THEN 'maize' ELSE 'beans' END AS crop, avg(p_retailprice) / 50 AS price_kes_kg
       FROM part JOIN pl ON p_partkey % 25 = nk GROUP BY ALL),
fm AS (SELECT rl.*, acres_tot, lb.* EXCLUDE (hhid), rn.* EXCLUDE (hhid), hd.* EXCLUDE (hhid), dw.* EXCLUDE (dist, crop),
       coalesce(purchase_wage_hours, 0) + coalesce(view_wage_hours, 0) AS later_hours, lb.hhid IS NOT NULL AS has_labour,
       {", ".join(f"coalesce({k}_{m}, 0) AS {k}_{m}" for k in [*_KINDS, "chem"] for m in ("kg", "kes"))},
       price_kes_kg, synth_kes / acres + seed_kes / acres + lpcost + coalesce(chem_kes, 0) / acres AS cost_acre
       FROM rl JOIN cp ON rl.dist = cp.dist AND rl.crop = cp.crop LEFT JOIN ac ON rl.hhid = ac.hhid LEFT JOIN lb ON rl.hhid = lb.hhid
       LEFT JOIN cw ON rl.hhid = cw.hhid AND rl.crop = cw.crop LEFT JOIN rn ON rl.hhid = rn.hhid LEFT JOIN hd ON rl.hhid = hd.hhid
       LEFT JOIN dw ON rl.dist = dw.dist AND rl.crop = dw.crop)"""

#: Result column: its text over ``fm``. The first ones are not rounded.
PLAIN = ["adopter", *E.FIELD_FLAGS, "head_female", "hhsize"]
_PER_ACRE = [
    *[f"{k}_{m}" for k in _FERT for m in ("kg", "kes")],
    *[f"{a}_{m}" for a in _ACTS for m in _LABOUR],
    *[f"{k}_{m}" for k in [*_KINDS, "chem"] for m in ("kg", "kes")],
    "seed_kg",
    "seed_kes",
]
MEASURES = {
    **{f"{c}_acre": f"{c} / acres" for c in _PER_ACRE},
    "yield_kg_acre": "harvest_kg / acres",
    "later_wage_hours_acre": "CASE WHEN has_labour THEN later_hours / acres END",
    "revenue_acre": "harvest_kg / acres * price_kes_kg",
    "acres_pct": "acres / acres_tot",
    "rain_anomaly": "main07 / qwetpre",
    **{c: c for c in ("acres", "lpcost", "cost_acre", "qwetit", "qwetxt", "head_age")},
}
#: Prices spread over many orders of size, so they are shown as logs.
PRICES = [f"{k}_price" for k in [*_KINDS, "chem"]]
#: Sums of given amounts end after a few decimals, where fewer digits would leave halves to round.
DIGITS = {"acres": 8, "lpcost": 8}
LOGGED = ["yield_kg_acre", "seed_kg_acre", "synth_kg_acre", "cost_acre", "chem_price", "rain_anomaly"]


@query(
    "farm_model_table",
    f"""WITH {FARM_SQL} SELECT dist, hhid, crop, {', '.join(PLAIN)}, {', '.join(f'{rnd(x, DIGITS.get(c, 4))} AS {c}' for c, x in MEASURES.items())},
        {', '.join(f"{rnd(f'ln({c})', 8)} AS log_{c}" for c in PRICES)} FROM fm""",
)
def farm_model_table(spark, d):
    """Every household and crop, per acre, with labour by kind, chemicals by kind, prices, rainfall and head."""
    measures = [rounded(F.col(c), DIGITS.get(c, 4)).alias(c) for c in MEASURES]
    prices = [rounded(F.ln(c), 8).alias(f"log_{c}") for c in PRICES]
    return farms(spark, d).select("dist", "hhid", "crop", *PLAIN, *measures, *prices)


@query(
    "farm_log_rows",
    f"""WITH {FARM_SQL} SELECT dist, {", ".join(f"{rnd(f'CASE WHEN ({MEASURES.get(c, c)}) = 0 THEN 0 WHEN ({MEASURES.get(c, c)}) > 0 THEN ln({MEASURES.get(c, c)}) END', 6)} AS {c}" for c in LOGGED)},
        {", ".join(E.FIELD_FLAGS)} FROM fm
        WHERE crop = 'maize' AND cost_acre > 0 AND acres > 0 AND harvest_kg / acres > 1 AND main07 / qwetpre IS NOT NULL""",
)
def farm_log_rows(spark, d):
    """The rows a yield model is fitted on: maize, logged."""
    rows = E.log_table(farms(spark, d), "maize", LOGGED, E.FIELD_FLAGS)
    return rows.select("dist", *[rounded(F.col(c), 6).alias(c) for c in LOGGED], *E.FIELD_FLAGS)
