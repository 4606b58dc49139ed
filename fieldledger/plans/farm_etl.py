"""From survey tables to the model table: one row per household and crop, per acre and logged.

Each survey table is aggregated to its own grain before it meets another, so every join below is on keys
that are unique on both sides, except the climate of divisions and the district prices, which go through the checked
dimension join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.functions import log_positive, lognormal_power_mean, nz, ratio, row_sum, safe_log, substring_recode, title_case, unit_factor
from fieldledger.operators import columns as C
from fieldledger.operators import reshape as R
from fieldledger.operators.aggregate import sum_safe, with_subtotal
from fieldledger.operators.joins import dimension_join, left_join_chain
from fieldledger.operators.lineage import materialise

# Survey codes.
CROPS = ["maize-dry", "maize-green", "beans"]
HYBRID_SEED = ["purchased new hybrid", "purchased hybrid & retained"]
GREEN_TO_DRY = 0.85
FERT_RULES = [
    ("CAN", "can"),
    ("NPK", "npk"),
    ("UREA", "urea"),
    ("dap", "dap"),
]
FERT_MIXES = ["NPK+CAN", "DAP + CAN", "UREA + CAN"]
SYNTHETIC = ["can", "npk", "urea", "dap"]
PEST_KINDS = ["Herbicide", "Pesticide", "Insecticide", "Fungicide"]
HOURS_PER_DAY = 8
FIELD_FLAGS = ["irrigated", "tenure_deed", "oxen", "tractor"]


def crop_by_field(crop: DataFrame) -> DataFrame:
    """Main-season crops per household, field and crop: dry-equivalent harvest, seed, share of hybrid entries."""
    kept = crop.filter(F.col("crop").isin(CROPS) & (F.col("harvest") == "main"))
    dry = F.when(F.col("crop") == "maize-green", F.col("kgharv") * GREEN_TO_DRY).otherwise(F.col("kgharv"))
    adopter = F.when(F.col("sdtype").isin(HYBRID_SEED), 1).otherwise(0)
    rows = kept.select(
        "dist",
        "hhid",
        "field",
        substring_recode("crop", [("maize", "maize")]).alias("crop"),
        dry.alias("kgharv"),
        "seedkg",
        "scost",
        adopter.alias("adopter"),
    )
    return rows.groupBy("dist", "hhid", "field", "crop").agg(
        *[sum_safe(c).alias(c) for c in ("kgharv", "seedkg", "scost")], F.avg("adopter").alias("adopter")
    )


def field_attributes(field: DataFrame) -> DataFrame:
    """Main-season fields with 0/1 attributes."""
    prep = F.col("landprep")

    def flag(condition):
        return F.when(condition, 1).otherwise(0)

    return field.filter(F.col("harvest") == "main").select(
        "hhid",
        "field",
        "acres",
        "lpcost",
        flag(F.col("watersrc").contains("irrig")).alias("irrigated"),
        flag(F.col("tenure") == "owned with title deed").alias("tenure_deed"),
        flag(prep == "oxen").alias("oxen"),
        flag(prep == "tractor").alias("tractor"),
    )


def fertiliser_wide(fert: DataFrame) -> DataFrame:
    """Kilograms and cost per field for each fertiliser class, manure and all synthetic classes together."""
    kept = fert.filter((F.col("harvest") == "main") & ~F.col("ferttype").isin(FERT_MIXES))
    rows = kept.select("hhid", "field", substring_recode("ferttype", FERT_RULES).alias("kind"), "fertotal", "fertcost")
    synthetic = rows.filter(F.col("kind").isin(SYNTHETIC))
    with_total = with_subtotal(synthetic, ["hhid", "field"], "kind", ["fertotal", "fertcost"], "synth")
    manure = rows.filter(F.col("kind") == "manure")
    kinds = [*SYNTHETIC, "synth", "manure"]
    long = R.union_all([with_total.select("hhid", "field", "kind", "fertotal", "fertcost"), manure.select(*rows.columns)])
    measures = long.withColumnsRenamed({"fertotal": "kg", "fertcost": "kes"})
    wide = R.pivot_measures(measures, ["hhid", "field"], "kind", kinds, ["kg", "kes"])
    return wide.drop("total_kg", "total_kes")


def labour_wide(labour: DataFrame, activities: list[str], later: list[str] | None = None) -> DataFrame:
    """Person-hours of men, women, children, adults, the family and hired people, and wage cost, by household and activity.

    ``later_wage_hours`` sums the hired hours of the activities ``later``, those that the cost of land preparation leaves out.
    """
    hours = F.col("lb01") * F.col("lb02") * HOURS_PER_DAY
    rows = labour.withColumns(
        {
            "wage_hours": hours,
            "male_hours": F.col("lb05") * F.col("lb06"),
            "female_hours": F.col("lb07") * F.col("lb08"),
            "child_hours": F.col("lb09") * F.col("lb10"),
            "wage_kes": hours * F.col("lb03") / HOURS_PER_DAY,
        }
    ).withColumn("adult_hours", row_sum(["male_hours", "female_hours"]))
    rows = rows.withColumn("family_hours", row_sum(["adult_hours", "child_hours"]))
    measures = ["wage_hours", "male_hours", "female_hours", "adult_hours", "child_hours", "family_hours", "wage_kes"]
    wide = R.pivot_measures(rows, ["hhid"], "activity", activities, measures)
    kept = [f"{a}_wage_hours" for a in later or [] if a in activities]
    return wide.withColumn("later_wage_hours", row_sum(kept)) if kept else wide


def pest_chemicals(inputs: DataFrame, bad_price: float | None = 76500.0) -> DataFrame:
    """Purchases of pest chemicals for the crops of the study, in kilograms whatever the purchase unit.

    Green and dry maize are one crop, as on the fields. Purchases at ``bad_price`` a kilogram are left out.
    """
    factor = unit_factor("punit")
    kept = inputs.filter(F.col("mcrop").isin(CROPS) & F.col("inputype").isin(PEST_KINDS))
    rows = kept.select(
        *[c for c in ("dist", "hhid") if c in inputs.columns],
        substring_recode("mcrop", [("maize", "maize")]).alias("crop"),
        F.lower("inputype").alias("kind"),
        (F.col("numpur") * factor).alias("kg"),
        (F.col("inputpr") / factor).alias("price"),
    ).withColumn("kes", F.col("kg") * F.col("price"))
    return rows if bad_price is None else C.drop_where(rows, F.col("price") == bad_price)


def chemicals_wide(inputs: DataFrame, bad_price: float | None = 76500.0) -> DataFrame:
    """Kilograms and cost of each pest chemical, and of all as ``chem_kg, chem_kes``, per household and crop."""
    kinds = [k.lower() for k in PEST_KINDS]
    wide = R.pivot_measures(pest_chemicals(inputs, bad_price), ["hhid", "crop"], "kind", kinds, ["kg", "kes"])
    return wide.withColumnsRenamed({"total_kg": "chem_kg", "total_kes": "chem_kes"})


def chemical_prices(inputs: DataFrame, bad_price: float | None = 76500.0) -> DataFrame:
    """District price of each pest chemical and of all (``chem_price``) per crop: the lognormal mean over households.

    A household's price is the mean of what it paid a kilogram, that of all chemicals its cost over its kilograms.
    Prices of zero have no logarithm and count nowhere; a price met in one household only has no deviation and gives NULL.
    """
    rows = pest_chemicals(inputs, bad_price)
    kinds = [*[k.lower() for k in PEST_KINDS], "chem"]
    # one row per household and crop, with the logged prices side by side
    per_kind = [log_positive(F.avg(F.when(F.col("kind") == k, F.col("price")))).alias(k) for k in kinds[:-1]]
    home = rows.groupBy("dist", "hhid", "crop").agg(*per_kind, log_positive(ratio(F.sum("kes"), F.sum("kg"))).alias("chem"))
    spread = home.groupBy("dist", "crop").agg(
        *[F.avg(k).alias(f"{k}_m") for k in kinds], *[F.stddev_samp(k).alias(f"{k}_s") for k in kinds]
    )
    return spread.select("dist", "crop", *[lognormal_power_mean(f"{k}_m", f"{k}_s", F.lit(1.0)).alias(f"{k}_price") for k in kinds])


def household_heads(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """``hhid, head_age, head_female`` and household size of the households that have both a head and a size.

    Several heads of one household give their mean age, and 1 if any is a woman.
    """
    heads = members.filter(F.col("da03") == "head").groupBy("hhid").agg(
        F.avg("age").alias("head_age"), F.max(F.when(F.col("gend") == "female", 1).when(F.col("gend") == "male", 0)).alias("head_female")
    )
    return heads.join(sizes.groupBy("hhid").agg(F.max("hhsize").alias("hhsize")), "hhid")


PLACE = ["prov", "dist", "div"]


def household_rain(rain: DataFrame, climate: DataFrame) -> DataFrame:
    """``hhid, main07`` and the mean climate of the villages of its division, for households whose division has any.

    The two surveys spell places differently: those of ``rain`` are put in title case first.
    """
    divisions = climate.groupBy(*PLACE).agg(*[F.avg(c).alias(c) for c in ("qwetpre", "qwetit", "qwetxt")])
    homes = rain.select("hhid", "main07", *[title_case(c).alias(c) for c in PLACE])
    return dimension_join(homes, divisions, PLACE).drop(*PLACE)


def farm_table(
    crop: DataFrame,
    field: DataFrame,
    fert: DataFrame,
    inputs: DataFrame,
    labour: DataFrame,
    rain: DataFrame,
    crop_price: DataFrame,
    activities: list[str],
    heads: DataFrame | None = None,
    later: list[str] | None = None,
) -> DataFrame:
    """Household-crop table: sums over fields, 0/1 columns of what holds on a share of 0.15 of them, quantities and costs per acre.

    ``rain`` is one row per household (``hhid, main07, qwetpre``; see ``household_rain``), so is ``heads``
    (``household_heads``) where given; ``crop_price`` is one row per district and crop.
    """
    fields = field_attributes(field)
    acres_total = fields.groupBy("hhid").agg(sum_safe("acres").alias("acres_tot"))
    fert_cols = fertiliser_wide(fert)
    by_field = crop_by_field(crop).join(fields, ["hhid", "field"]).join(fert_cols, ["hhid", "field"])
    flags = ["adopter", *FIELD_FLAGS]
    amounts = [c for c in by_field.columns if c not in ("dist", "hhid", "field", "crop", *flags)]
    rolled = by_field.groupBy("dist", "hhid", "crop").agg(
        *[sum_safe(c).alias(c) for c in amounts], *[F.avg(c).alias(c) for c in flags]
    )
    rolled = C.threshold_flags(rolled, flags)
    homes = [acres_total, labour_wide(labour, activities, later), *([] if heads is None else [heads]), rain]
    # the tables by household stand together, so that the rows move once for all of them
    wide = left_join_chain(rolled, [chemicals_wide(inputs), *homes])
    chem = [f"{k}_{m}" for k in [*[k.lower() for k in PEST_KINDS], "chem"] for m in ("kg", "kes")]
    wide = C.fill_block(wide, "chem_kg", chem).withColumnsRenamed(
        {"seedkg": "seed_kg", "scost": "seed_kes", "kgharv": "harvest_kg"}
    )
    per_acre = C.scale_columns(wide, r"_(kg|kes|hours)$", "acres", "_acre")
    cost = ["synth_kes_acre", "seed_kes_acre", "lpcost", "chem_kes_acre"]
    costed = per_acre.withColumnRenamed("harvest_kg_acre", "yield_kg_acre").withColumns(
        {
            "acres_pct": ratio("acres", "acres_tot"),
            "rain_anomaly": ratio("main07", "qwetpre"),
            "cost_acre": row_sum(cost),
        }
    )
    priced = dimension_join(costed, crop_price, ["dist", "crop"])
    return priced.withColumn("revenue_acre", F.col("yield_kg_acre") * nz("price_kes_kg"))


def model_table(
    crop: DataFrame,
    field: DataFrame,
    fert: DataFrame,
    inputs: DataFrame,
    labour: DataFrame,
    members: DataFrame,
    sizes: DataFrame,
    rain: DataFrame,
    climate: DataFrame,
    crop_price: DataFrame,
    activities: list[str],
    later: list[str],
) -> DataFrame:
    """The survey end to end: the household-crop table with rainfall, head, size and the district prices of chemicals.

    Households that lack a survey table keep their rows, with NULL in its columns.
    """
    farms = farm_table(
        crop, field, fert, inputs, labour, household_rain(rain, climate), crop_price, activities, household_heads(members, sizes), later
    )
    # the size check and the join read it
    prices = materialise(chemical_prices(inputs))
    return dimension_join(farms, prices, ["dist", "crop"], "left")


def log_table(farms: DataFrame, crop: str, continuous: list[str], flags: list[str]) -> DataFrame:
    """Model rows: one crop, positive cost and area, a yield above one, known rainfall; continuous columns logged."""
    C.require_columns(farms, ["dist", *continuous, *flags])
    usable = (
        (F.col("crop") == crop)
        & (F.col("cost_acre") > 0)
        & (F.col("acres") > 0)
        & (F.col("yield_kg_acre") > 1)
        & F.col("rain_anomaly").isNotNull()
    )
    return farms.filter(usable).select("dist", *[safe_log(c).alias(c) for c in continuous], *flags)
