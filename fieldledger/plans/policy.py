"""Strata, supply, intervention and equilibrium queries."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import functions as F

from fieldledger.functions import log_positive, norm_cdf, ratio, rounded
from fieldledger.operators import supply as P
from fieldledger.operators.joins import dimension_join, with_grid, with_levels
from fieldledger.operators.reshape import nearest_cell
from fieldledger.operators.series import season_drift
from fieldledger.operators.truncation import (
    STEPS,
    mean_gap_text,
    untruncate_lower,
    untruncate_upper,
)
from fieldledger.plans.registry import duck_double, query, rnd, sql_cdf, sql_log, sql_pdf
from fieldledger.plans.views import (
    CONTROLS,
    DISTRICT_SQL,
    FARMS_SQL,
    H,
    KAPPA_RAIN,
    MONTHLY_SQL,
    N_FARMS,
    farms,
    farms_by_district,
    monthly_prices,
    table,
)

ETA = P.eta_of(H)


def _round(df, digits: dict[str, int], *keep: str):
    return df.select(*keep, *[rounded(c, n).alias(c) for c, n in digits.items()])


def _rounded_sql(digits: dict[str, int]) -> str:
    return ", ".join(f"{rnd(c, n)} AS {c}" for c, n in digits.items())


# ---------------------------------------------------------------------------------------------- strata

UNIT_DIGITS = {"mu_cost": 3, "mu_cost_h": 6, "mu_yield": 5, "m_unit": 6, "s_unit": 6, "mu_unit": 4}


def _unit_sql(source: str) -> str:
    """Closed forms from cost moments and controls, as in the strata table."""
    return f"""
  SELECT *, v * mu_k * mu_cost_h AS mu_yield, exp(m_unit + s_unit * s_unit / 2) AS mu_unit FROM (
    SELECT *, exp(m_cost + s_cost * s_cost / 2) AS mu_cost,
           exp({H} * m_cost + {H * H}::DOUBLE * s_cost * s_cost / 2) AS mu_cost_h,
           {1 - H} * m_cost - mk - ln(v) AS m_unit,
           CASE WHEN {(1 - H) ** 2}::DOUBLE * s_cost * s_cost > sk * sk
                THEN sqrt({(1 - H) ** 2}::DOUBLE * s_cost * s_cost - sk * sk) END AS s_unit FROM {source})"""


STRATA_SQL = f"""{FARMS_SQL},
ctl AS (
  SELECT avg(log_area * -0.2::DOUBLE) + avg(log_seed * 0.1::DOUBLE) AS mk,
         sqrt(var_samp(log_area * -0.2::DOUBLE) + var_samp(log_seed * 0.1::DOUBLE)) AS sk FROM farms),
base AS (
  SELECT label, log_cost, yield, exp(log_v) AS v, exp(log_area * -0.2::DOUBLE + log_seed * 0.1::DOUBLE) AS k, mk, sk,
         exp(mk + sk * sk / 2) AS mu_k FROM farms, ctl),
lab AS (
  SELECT label, max(v) AS v, avg(log_cost) AS m_cost, stddev_samp(log_cost) AS s_cost, avg(yield) AS mean_yield,
         avg(k) AS mean_k, count(*) AS n, max(mk) AS mk, max(sk) AS sk, max(mu_k) AS mu_k FROM base GROUP BY label),
both_rows AS (
  SELECT label, v, m_cost, s_cost, mean_yield, mean_k, n, mk, sk, mu_k,
         CAST(row_number() OVER (ORDER BY v, label) AS VARCHAR) AS stratum FROM lab
  UNION ALL
  SELECT 'Sample', avg(v), avg(log_cost), stddev_samp(log_cost), avg(yield), avg(k), count(*), max(mk), max(sk),
         max(mu_k), 'All' FROM base),
fr AS (SELECT *, n / (SELECT count(*) FROM farms)::DOUBLE AS frac FROM both_rows),
strata AS ({_unit_sql("fr")})"""

STRATA_DIGITS = {"v": 6, "m_cost": 6, "s_cost": 6, "mean_yield": 4, "mean_k": 6, "frac": 8, **UNIT_DIGITS}


def strata(spark, d):
    return P.strata_table(farms(spark, d), CONTROLS, H)


@query("strata_table", f"WITH {STRATA_SQL} SELECT label, stratum, CAST(n AS BIGINT) AS n, {_rounded_sql(STRATA_DIGITS)} FROM strata")
def strata_table(spark, d):
    return _round(strata(spark, d), STRATA_DIGITS, "label", "stratum", "n")


# ------------------------------------------------------------------------------- truncation recovery


def _mean_gap_sql(z: str) -> str:
    return mean_gap_text(z, duck_double)


def _solve_sql(source: str, key: str, out: str, side: int, cut: str, m_bar: str, s_bar: str) -> str:
    """Bisection for the cut as a recursive table expression, then the recovered ``z, s, m``."""
    gap = f"({side}) * (ln({cut}) - {m_bar})"
    return f"""
{out}_bis AS (
  SELECT {key}, {gap} / {s_bar} AS t, -3 / sqrt({gap} / {s_bar} - 1) - 5 AS lo, {gap} / {s_bar} + 1 AS hi, 0 AS it
  FROM {source} WHERE {gap} / {s_bar} > 1
  UNION ALL
  SELECT {key}, t, CASE WHEN sg < t THEN mid ELSE lo END, CASE WHEN sg < t THEN hi ELSE mid END, it + 1 FROM (
    SELECT *, g / sqrt(1 - (g - mid) * g) AS sg FROM (
      SELECT *, {_mean_gap_sql("mid")} AS g FROM (SELECT *, (lo + hi) / 2 AS mid FROM {out}_bis WHERE it < {STEPS})))),
{out}_z AS (SELECT {key}, (lo + hi) / 2 AS z FROM {out}_bis WHERE it = {STEPS}),
{out}_s AS (
  SELECT src.*, r.z, {gap} / {_mean_gap_sql("r.z")} AS s FROM {source} src LEFT JOIN {out}_z r ON src.{key} = r.{key}),
{out} AS (SELECT *, ln({cut}) - ({side}) * z * s AS m FROM {out}_s)"""


MARKET_SQL = f"""{DISTRICT_SQL},
mk0 AS (
  SELECT district, count(*) AS n, avg(exp(log_v)) AS v, avg(log_cost) AS m_cost, stddev_samp(log_cost) AS s_cost,
         max(exp({1 - H} * log_cost - (log_area * -0.2::DOUBLE + log_seed * 0.1::DOUBLE) - log_v)) AS price,
         avg(area) AS mean_area,
         avg(log_area * -0.2::DOUBLE) + avg(log_seed * 0.1::DOUBLE) AS mk,
         sqrt(var_samp(log_area * -0.2::DOUBLE) + var_samp(log_seed * 0.1::DOUBLE)) AS sk FROM dfarms GROUP BY district),
mk1 AS (SELECT *, exp(mk + sk * sk / 2) AS mu_k FROM mk0),
mkt AS ({_unit_sql("mk1")}),
{_solve_sql("mkt", "district", "full_mkt", 1, "price", "m_unit", "s_unit")},
unc AS (
  SELECT *, v * mu_k * mu_c_h AS mu_y, exp(m + s * s / 2) AS mu_unit_full FROM (
    SELECT *, exp(m_c + s_c * s_c / 2) AS mu_c, exp({H} * m_c + {H * H}::DOUBLE * s_c * s_c / 2) AS mu_c_h FROM (
      SELECT *, (ln(v) + mk + m) / {1 - H} AS m_c, sqrt(sk * sk + s * s) / {1 - H} AS s_c FROM full_mkt)))"""


def markets(spark, d, more=None):
    """Per-district moments with the full-population parameters recovered, and further aggregates of its farms."""
    sample = P.market_table(farms_by_district(spark, d), ["district"], CONTROLS, H, more)
    full = P.unconditional(untruncate_upper(sample, "m_unit", "s_unit", "price"), H)
    return full.withColumn("mu_unit_full", F.exp(F.col("m") + F.col("s") * F.col("s") / 2))


UPPER_DIGITS = {"price": 4, "m_unit": 6, "s_unit": 6, "z": 5, "m": 6, "s": 6}


@query(
    "untruncate_upper",
    f"WITH RECURSIVE {MARKET_SQL} SELECT district, {_rounded_sql(UPPER_DIGITS)} FROM full_mkt",
)
def untruncate_upper_query(spark, d):
    sample = P.market_table(farms_by_district(spark, d), ["district"], CONTROLS, H)
    return _round(untruncate_upper(sample, "m_unit", "s_unit", "price"), UPPER_DIGITS, "district")


LOWER_SQL = f"""{DISTRICT_SQL},
lo0 AS (
  SELECT district, avg(ln(yield)) AS m_bar, stddev_samp(ln(yield)) AS s_bar, min(yield) AS cut FROM dfarms GROUP BY district),
{_solve_sql("lo0", "district", "full_lo", -1, "cut", "m_bar", "s_bar")}"""
LOWER_DIGITS = {"cut": 4, "m_bar": 6, "s_bar": 6, "z": 5, "m": 6, "s": 6}


@query(
    "untruncate_lower",
    f"WITH RECURSIVE {LOWER_SQL} SELECT district, {_rounded_sql(LOWER_DIGITS)} FROM full_lo",
)
def untruncate_lower_query(spark, d):
    y = log_positive("yield")
    sample = farms_by_district(spark, d).groupBy("district").agg(
        F.avg(y).alias("m_bar"), F.stddev_samp(y).alias("s_bar"), F.min("yield").alias("cut")
    )
    return _round(untruncate_lower(sample, "m_bar", "s_bar", "cut"), LOWER_DIGITS, "district")


SAMPLE_SQL = f"""{STRATA_SQL},
smp AS (
  SELECT s.*, 1 AS one, p.price, p.mean_area FROM strata s,
    (SELECT max(exp({1 - H} * log_cost - (log_area * -0.2::DOUBLE + log_seed * 0.1::DOUBLE) - log_v)) AS price,
            avg(area) AS mean_area FROM farms) p WHERE s.stratum = 'All'),
{_solve_sql("smp", "one", "full_smp", 1, "price", "m_unit", "s_unit")},
facts AS (
  SELECT m AS m_full, s AS s_full, price, mean_area, (ln(v) + mk + m) / {1 - H} AS m_c_all,
         sqrt(sk * sk + s * s) / {1 - H} AS s_c_all, {sql_cdf("(ln(price) - m) / s")} AS employment_rate,
         price * exp(-m_unit + s_unit * s_unit / 2) AS mu_return FROM full_smp),
st AS (
  SELECT *, v * mu_k * mu_c_h AS mu_y FROM (
    SELECT *, exp(m_c + s_c * s_c / 2) AS mu_c, exp({H} * m_c + {H * H}::DOUBLE * s_c * s_c / 2) AS mu_c_h,
           exp(m_c_all + s_c_all * s_c_all / 2) AS mu_c_all FROM (
      SELECT s.*, f.*, (ln(v) + mk + m_full) / {1 - H} AS m_c, sqrt(sk * sk + s_full * s_full) / {1 - H} AS s_c
      FROM strata s, facts f WHERE s.stratum <> 'All')))"""


def recovered(spark, d):
    """Strata with unconditional moments, without the sample row."""
    return P.recovered_strata(strata(spark, d), H)


UNCOND_DIGITS = {"m_c": 6, "s_c": 6, "mu_c": 2, "mu_c_h": 6, "mu_y": 5}


@query(
    "strata_unconditional",
    f"WITH RECURSIVE {SAMPLE_SQL} SELECT label, stratum, {_rounded_sql(UNCOND_DIGITS)} FROM st",
)
def strata_unconditional(spark, d):
    return _round(recovered(spark, d), UNCOND_DIGITS, "label", "stratum")


@query(
    "strata_recombine",
    f"""WITH {STRATA_SQL} SELECT {rnd("sum(v * frac)", 6)} AS v, {rnd("sum(mean_yield * frac)", 4)} AS mean_yield,
        {rnd("sum(frac)", 8)} AS frac FROM strata WHERE stratum <> 'All'""",
)
def strata_recombine(spark, d):
    rows = strata(spark, d).filter(F.col("stratum") != "All")
    return rows.agg(
        rounded(P.strata_recombine("v"), 6).alias("v"),
        rounded(P.strata_recombine("mean_yield"), 4).alias("mean_yield"),
        rounded(F.sum("frac"), 8).alias("frac"),
    )


@query(
    "truncation_rates",
    f"""WITH RECURSIVE {MARKET_SQL} SELECT district, {rnd(sql_cdf("(ln(price) - m) / s"), 8)} AS employment_rate,
        {rnd(sql_cdf(f"((ln(price) - m) / s - {ETA!r}::DOUBLE * s)"), 8)} AS prob_profit FROM unc""",
)
def truncation_rates(spark, d):
    out = P.truncation_rates(markets(spark, d), H)
    return _round(out, {"employment_rate": 8, "prob_profit": 8}, "district")


# --------------------------------------------------------------------------------------- supply curves


def _axis_sql(lo: float, hi: float, n: int, ix: str, name: str) -> str:
    step = (hi - lo) / (n - 1) if n > 1 else 0.0
    return f"(SELECT i AS {ix}, {lo!r}::DOUBLE + i * {step!r}::DOUBLE AS {name} FROM range({n}) t(i))"


CURVE = (0.02, 2.0, 50)
CURVE_SQL = f"""{MARKET_SQL},
cv AS (
  SELECT *, (ln(p) - m) / s - {ETA!r}::DOUBLE * s AS zz FROM (
    SELECT u.*, g.fraction, g.fraction * u.price AS p FROM unc u, {_axis_sql(*CURVE, "gi", "fraction")} g)),
curve AS (
  SELECT cv.district, fraction, p, r.rainfall,
         mean_area * {N_FARMS!r}::DOUBLE * r.rain_factor * mu_y * {sql_cdf("zz")} * 1e-9 AS supply_mmt,
         {sql_pdf("zz")} / nullif({sql_cdf("zz")}, 0) / s AS elasticity,
         {sql_cdf("(ln(p) - m) / s")} AS employment_rate
  FROM cv, (VALUES {", ".join(f"('{k}', {v ** KAPPA_RAIN!r}::DOUBLE)" for k, v in P.RAINFALL.items())})
    r(rainfall, rain_factor))"""


def curve(spark, d):
    return P.supply_curve(markets(spark, d), H, N_FARMS, KAPPA_RAIN, *CURVE)


CURVE_DIGITS = {"fraction": 6, "p": 4, "supply_mmt": 6, "elasticity": 5, "employment_rate": 8}


@query(
    "supply_curve",
    f"WITH RECURSIVE {CURVE_SQL} SELECT district, rainfall, {_rounded_sql(CURVE_DIGITS)} FROM curve",
)
def supply_curve(spark, d):
    return _round(curve(spark, d), CURVE_DIGITS, "district", "rainfall")


M_P, S_P, HORIZON = 0.02, 0.12, 5.0


def _risk_sql(source: str, fraction: tuple, rain: tuple | None) -> str:
    grid = f"{_axis_sql(*fraction, 'gi', 'fraction')} g"
    rains = f", {_axis_sql(*rain, 'gr', 'rain_ratio')} r" if rain else ", (SELECT 1.0::DOUBLE AS rain_ratio) r"
    root = HORIZON**0.5
    power = KAPPA_RAIN * ETA / H
    return f"""
rk0 AS (
  SELECT u.*, g.fraction, r.rain_ratio, g.fraction * u.price AS p FROM {source} u, {grid}{rains}),
rk1 AS (
  SELECT *, ({ETA!r}::DOUBLE * ln(mu_unit_full / (p * exp({-M_P * HORIZON!r}::DOUBLE)))
             - {(ETA * M_P - ETA**2 * S_P**2 / 2) * HORIZON!r}::DOUBLE) / {ETA * S_P * root!r}::DOUBLE AS zz FROM rk0),
rk2 AS (
  SELECT *, {sql_cdf("(-zz)")} AS participation, mean_area * {N_FARMS!r}::DOUBLE * mu_y
            * pow(fraction, {ETA!r}::DOUBLE) * 1e-9 AS b0 FROM rk1),
risk AS (
  SELECT *, b0 * participation AS supply, b0 * participation * pow(rain_ratio * 2, {power!r}::DOUBLE) AS supply_high,
         b0 * participation * pow(rain_ratio / 2, {power!r}::DOUBLE) AS supply_low,
         {ETA!r}::DOUBLE + {sql_pdf("(-zz)")} / nullif(participation, 0) / {S_P * root!r}::DOUBLE AS elasticity,
         -({sql_pdf("(-zz)")} / nullif(participation, 0)) * ({ETA * S_P * root!r}::DOUBLE - zz) AS risk_elasticity
  FROM rk2)"""


RISK_DIGITS = {
    "fraction": 6,
    "participation": 8,
    "supply": 6,
    "supply_high": 6,
    "supply_low": 6,
    "elasticity": 5,
    "risk_elasticity": 4,
}
RISK_GRID = (0.25, 2.0, 50)
# Ranges and steps of the supply map, price ratio and rainfall ratio.
MAP_GRID, MAP_RAIN = (0.75, 1.2, 50), (0.2, 3.0, 50)


@query(
    "supply_curve_risk",
    f"""WITH RECURSIVE {MARKET_SQL}, {_risk_sql("unc", RISK_GRID, None)}
        SELECT district, {_rounded_sql(RISK_DIGITS)} FROM risk""",
)
def supply_curve_risk(spark, d):
    out = P.supply_with_risk(markets(spark, d), H, N_FARMS, KAPPA_RAIN, M_P, S_P, HORIZON, RISK_GRID)
    return _round(out, RISK_DIGITS, "district")


MAP_DIGITS = {"fraction": 6, "rain_ratio": 6, "supply_low": 6, "supply_high": 6}


@query(
    "supply_map",
    f"""WITH RECURSIVE {MARKET_SQL}, {_risk_sql("unc", MAP_GRID, MAP_RAIN)}
        SELECT district, {_rounded_sql(MAP_DIGITS)} FROM risk""",
)
def supply_map(spark, d):
    out = P.supply_with_risk(markets(spark, d), H, N_FARMS, KAPPA_RAIN, M_P, S_P, HORIZON, MAP_GRID, MAP_RAIN)
    return _round(out, MAP_DIGITS, "district")


H_LEVELS = [0.25, 0.5, 0.75]
SENS_DIGITS = {"fraction": 6, "h": 4, "employment_rate": 8, "prob_profit": 8, "elasticity": 5}


@query(
    "homogeneity_sensitivity",
    f"""WITH RECURSIVE {MARKET_SQL}, sn AS (SELECT district, m, s, fraction, h, h / (1 - h) AS eta,
          (ln(fraction * price) - m) / s AS a FROM unc, {_axis_sql(0.05, 2.0, 40, "gi", "fraction")} g,
          (VALUES {", ".join(f"({h}::DOUBLE)" for h in H_LEVELS)}) t(h)),
        so AS (SELECT district, fraction, h, {sql_cdf("a")} AS employment_rate, {sql_cdf("(a - eta * s)")} AS prob_profit,
          {sql_pdf("(a - eta * s)")} / nullif({sql_cdf("(a - eta * s)")}, 0) / s AS elasticity FROM sn)
        SELECT district, {_rounded_sql(SENS_DIGITS)} FROM so""",
)
def homogeneity_sensitivity(spark, d):
    out = P.homogeneity_sensitivity(markets(spark, d), H_LEVELS, 0.05, 2.0, 40)
    return _round(out, SENS_DIGITS, "district")


@query(
    "scenario_grid",
    f"""WITH RECURSIVE {MARKET_SQL} SELECT district, h, dln_g, {rnd("fraction * price", 4)} AS p,
        {rnd("h / (1 - h) * ln(fraction * price) + dln_g - m_unit", 6)} AS log_margin
        FROM unc, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) a(h), (VALUES (0.1::DOUBLE), (0.3::DOUBLE)) b(dln_g),
        {_axis_sql(0.5, 1.5, 5, "gi", "fraction")} g""",
)
def scenario_grid(spark, d):
    """Every combination of scenario values for each district, generated in place."""
    g = with_grid(with_levels(with_levels(markets(spark, d), "h", H_LEVELS), "dln_g", [0.1, 0.3]), "fraction", 0.5, 1.5, 5)
    p = F.col("fraction") * F.col("price")
    margin = F.col("h") / (1 - F.col("h")) * F.ln(p) + F.col("dln_g") - F.col("m_unit")
    return g.select("district", "h", "dln_g", rounded(p, 4).alias("p"), rounded(margin, 6).alias("log_margin"))


# --------------------------------------------------------------------------------------- interventions

# The intervention scenario (productivity gain, expected-price response, ratio of elasticities, subsidy).
SCENARIO = {"dln_g": 0.3, "alpha_dlw": 0.2, "nu_ratio": 0.75, "subsidy": 10000.0}
DLN_P = -SCENARIO["alpha_dlw"] * SCENARIO["nu_ratio"]
# Ranges and steps of the policy grid, price change and subsidy.
GRID_DLW, GRID_SUBSIDY = (0.19, 0.23, 30), (3000.0, 20000.0, 30)


def _impact_sql(source: str, out: str, nu: str, nu_h: str, subsidy: str, dln_g: float) -> str:
    """Per-stratum impact for price-ratio changes given as SQL expressions."""
    farms_n = f"frac * {N_FARMS!r}::DOUBLE * mean_area"
    return f"""
{out}_a AS (
  SELECT *, {nu} + {dln_g}::DOUBLE AS net, {nu_h} + {dln_g}::DOUBLE AS net_h,
         CASE WHEN {nu} + {dln_g}::DOUBLE < 0
              THEN (-{H}::DOUBLE * {subsidy}) / ({nu} + {dln_g}::DOUBLE) END AS ceiling FROM {source}),
{out}_b AS (SELECT *, (ln(ceiling) - m_c) / s_c AS zi FROM {out}_a),
{out} AS (
  SELECT *, {sql_cdf("zi")} AS adoption_rate, {sql_cdf("((ln(ceiling) - m_c_all) / s_c)")} AS adoption_all,
         {farms_n} * {subsidy} * {sql_cdf("zi")} * 1e-6 AS subsidy_cost,
         {farms_n} * net * mu_return * employment_rate
           * (mu_c_all * {sql_cdf("(zi - s_c)")} - ceiling * {sql_cdf("zi")}) * 1e-6 AS welfare_change,
         {farms_n} * mu_y * net_h / {1 - H} * {sql_cdf(f"(zi - {H}::DOUBLE * s_c)")} * 1e-6 AS supply_change FROM {out}_b)"""


IMPACT_SQL = f"""{SAMPLE_SQL}, {_impact_sql(
    "st",
    "impact",
    f"({DLN_P - SCENARIO['alpha_dlw']!r}::DOUBLE)",
    f"({H * DLN_P - SCENARIO['alpha_dlw']!r}::DOUBLE)",
    f"{SCENARIO['subsidy']}::DOUBLE",
    SCENARIO["dln_g"],
)}"""
IMPACT_DIGITS = {"ceiling": 3, "adoption_rate": 8, "subsidy_cost": 2, "welfare_change": 2, "supply_change": 5}


def impact(rows):
    return P.intervention_impact(rows, H, SCENARIO, N_FARMS)


@query(
    "intervention_impact",
    f"WITH RECURSIVE {IMPACT_SQL} SELECT label, stratum, {_rounded_sql(IMPACT_DIGITS)} FROM impact",
)
def intervention_impact(spark, d):
    return _round(impact(recovered(spark, d)), IMPACT_DIGITS, "label", "stratum")


TOTAL_DIGITS = {
    "adoption_rate": 8,
    "adoption_recombined": 8,
    "supply_change": 5,
    "welfare_change": 2,
    "subsidy_cost": 2,
    "net_welfare": 2,
}


def _total_sql(source: str, out: str, keys: list[str], subsidy: str, *extra: str) -> str:
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    head = "".join(f"{k}, " for k in keys) + "".join(f"{e}, " for e in extra)
    return f"""
{out}_t AS (
  SELECT {head}max({subsidy}) AS subsidy, max(adoption_all) AS adoption_rate, sum(frac * adoption_rate) AS adoption_recombined,
         sum(supply_change) AS supply_change, sum(welfare_change) AS welfare_change, max(mean_area) AS area
  FROM {source}{group}),
{out}_c AS (SELECT *, {N_FARMS!r}::DOUBLE * area * subsidy * adoption_rate * 1e-6 AS subsidy_cost FROM {out}_t),
{out} AS (SELECT *, welfare_change - subsidy_cost AS net_welfare FROM {out}_c)"""


@query(
    "intervention_total",
    f"""WITH RECURSIVE {IMPACT_SQL}, {_total_sql("impact", "tot", [], f"{SCENARIO['subsidy']}::DOUBLE")}
        SELECT {_rounded_sql(TOTAL_DIGITS)} FROM tot""",
)
def intervention_total(spark, d):
    return _round(P.intervention_total(impact(recovered(spark, d)), N_FARMS), TOTAL_DIGITS)


def _stratum_curve(rows):
    g = with_grid(rows, "fraction", 0.1, 2.0, 20)
    z = (F.ln(F.col("fraction") * F.col("price")) - F.col("m_full")) / F.col("s_full") - ETA * F.col("s_full")
    from_stratum = F.col("frac") * F.col("mean_area") * N_FARMS * F.col("mu_y")
    supply = from_stratum * norm_cdf("z") * 1e-9
    return g.withColumn("z", z).groupBy("fraction").agg(F.sum(supply).alias("supply_mmt"))


@query(
    "supply_curve_shift",
    f"""WITH RECURSIVE {IMPACT_SQL}, sc AS (SELECT fraction, frac * mean_area * {N_FARMS!r}::DOUBLE * mu_y
          * {sql_cdf(f"((ln(fraction * price) - m_full) / s_full - {ETA!r}::DOUBLE * s_full)")} * 1e-9 AS q
          FROM st, {_axis_sql(0.1, 2.0, 20, "gi", "fraction")} g),
        su AS (SELECT fraction, sum(q) AS q FROM sc GROUP BY fraction), dq AS (SELECT sum(supply_change) AS dq FROM impact)
        SELECT {rnd("fraction", 6)} AS fraction, {rnd("q", 6)} AS supply_mmt, {rnd("q + dq * 1e-3", 6)} AS supply_shifted
        FROM su, dq""",
)
def supply_curve_shift(spark, d):
    rows = recovered(spark, d)
    shifted = P.shift_supply(_stratum_curve(rows), "supply_mmt", P.intervention_total(impact(rows), N_FARMS))
    return _round(shifted, {"fraction": 6, "supply_mmt": 6, "supply_shifted": 6})


GRID_SQL = f"""{SAMPLE_SQL},
cells AS (
  SELECT st.*, a.i, a.dlw, b.j, b.sub, -a.dlw * {1 + SCENARIO["nu_ratio"]}::DOUBLE AS nu,
         -a.dlw * {1 + H * SCENARIO["nu_ratio"]}::DOUBLE AS nu_h
  FROM st, {_axis_sql(*GRID_DLW, "i", "dlw")} a, {_axis_sql(*GRID_SUBSIDY, "j", "sub")} b),
{_impact_sql("cells", "cell", "nu", "nu_h", "sub", SCENARIO["dln_g"])},
{_total_sql("cell", "grid", ["i", "j"], "sub", "max(nu) AS dln_nu")}"""


def grid(spark, d):
    return P.policy_grid(
        recovered(spark, d), H, SCENARIO["dln_g"], SCENARIO["nu_ratio"], GRID_DLW, GRID_SUBSIDY, N_FARMS
    )


GRID_DIGITS = {"dln_nu": 6, "subsidy": 4, **TOTAL_DIGITS}


@query(
    "policy_grid",
    f"""WITH RECURSIVE {GRID_SQL} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {_rounded_sql(GRID_DIGITS)}
        FROM grid""",
)
def policy_grid(spark, d):
    return _round(grid(spark, d), GRID_DIGITS, "i", "j")


@query(
    "nearest_grid_cell",
    f"""WITH RECURSIVE {GRID_SQL}, nr AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(subsidy - 10000.0), subsidy)
          AS k FROM grid)
        SELECT CAST(i AS INTEGER) AS i, {rnd("subsidy", 4)} AS subsidy, {rnd("adoption_rate", 8)} AS adoption_rate
        FROM nr WHERE k = 1""",
)
def nearest_grid_cell(spark, d):
    best = nearest_cell(grid(spark, d), ["i"], "subsidy", 10000.0, ["adoption_rate"])
    return _round(best, {"subsidy": 4, "adoption_rate": 8}, "i")


# ----------------------------------------------------------------- production decomposition and markets

INPUT_COEFS = {"A": 0.05, "N": 0.08, "R": 0.12}
CD_INTERCEPT, CD_PRICE, CD_AREA = 4.0, 900.0, -0.2

CD_SQL = f"""{DISTRICT_SQL},
pr AS (
  SELECT l_orderkey AS farm_id, {", ".join(
      f"coalesce(sum(CASE WHEN l_returnflag = '{v}' THEN {e} END), 0) AS {v}_{m}"
      for v in INPUT_COEFS
      for m, e in (("kg", "l_quantity"), ("kes", "l_extendedprice"))
  )} FROM lineitem GROUP BY l_orderkey),
fp AS (SELECT f.*, pr.* EXCLUDE (farm_id) FROM dfarms f JOIN pr ON f.farm_id = pr.farm_id),
cd0 AS (
  SELECT *, {" + ".join(f"(CASE WHEN {v}_kg <> 0 THEN {a}::DOUBLE ELSE 0 END)" for v, a in INPUT_COEFS.items())} AS h,
         exp({" + ".join(f"(CASE WHEN {v}_kg <> 0 THEN ({a}::DOUBLE * ln({a}::DOUBLE)) ELSE 0 END)" for v, a in INPUT_COEFS.items())}) AS beta_a,
         exp({" + ".join(f"(CASE WHEN {v}_kg <> 0 THEN {a}::DOUBLE * coalesce({sql_log(f'({v}_kes / {v}_kg)')}, 0) ELSE 0 END)" for v, a in INPUT_COEFS.items())}) AS beta_w,
         exp(log_area * -0.2::DOUBLE + log_seed * 0.1::DOUBLE) AS beta_k FROM fp),
cd AS (
  SELECT *, beta_a * beta_k / beta_w AS beta,
         exp({CD_INTERCEPT}::DOUBLE) * (beta_a * beta_k / beta_w) * pow(cost / h, h) AS expected_yield,
         exp({CD_INTERCEPT}::DOUBLE) * (beta_a * beta_k / beta_w) * {CD_PRICE} * pow(cost / h, h - 1) AS budget_multiplier
  FROM cd0)"""


def decomposed(spark, d):
    """Farms with their use and price of each input, decomposed by the technology coefficients."""
    prices = {f"{v}_price": ratio(f"{v}_kes", f"{v}_kg") for v in INPUT_COEFS}
    inputs = {f"{v}_kg": (a, f"{v}_price") for v, a in INPUT_COEFS.items()}
    base = farms_by_district(spark, d).withColumns({**prices, "output_price": F.lit(CD_PRICE)})
    return P.cobb_douglas(base, CD_INTERCEPT, inputs, CONTROLS, "cost", "output_price")


CD_DIGITS = {"h": 6, "beta": 8, "expected_yield": 5, "budget_multiplier": 6, "area_opt": 6}


@query(
    "cobb_douglas_expected",
    f"""WITH {CD_SQL}, ao AS (SELECT *, {1 + CD_AREA} / h AS area_opt FROM cd)
        SELECT farm_id, {_rounded_sql(CD_DIGITS)} FROM ao""",
)
def cobb_douglas_expected(spark, d):
    out = decomposed(spark, d).withColumn("area_opt", P.optimal_area(CD_AREA, "h"))
    return _round(out, CD_DIGITS, "farm_id")


@query(
    "rationality_split",
    f"""WITH {CD_SQL} SELECT district, CAST(count(*) AS BIGINT) AS n,
        CAST(sum(CASE WHEN budget_multiplier > h THEN 1 ELSE 0 END) AS BIGINT) AS n_rational,
        {rnd("avg(CASE WHEN budget_multiplier > h THEN 1.0 ELSE 0.0 END)", 6)} AS rate,
        {rnd("avg(CASE WHEN budget_multiplier > h THEN cost END)", 3)} AS cost_rational,
        {rnd("avg(CASE WHEN budget_multiplier <= h THEN cost END)", 3)} AS cost_irrational
        FROM cd GROUP BY district""",
)
def rationality_split(spark, d):
    rational = F.col("budget_multiplier") > F.col("h")
    return decomposed(spark, d).groupBy("district").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(rational, 1).otherwise(0)).alias("n_rational"),
        rounded(F.avg(F.when(rational, 1.0).otherwise(0.0)), 6).alias("rate"),
        rounded(F.avg(F.when(rational, F.col("cost"))), 3).alias("cost_rational"),
        rounded(F.avg(F.when(~rational, F.col("cost"))), 3).alias("cost_irrational"),
    )


ETA_D = -0.98
EQ_SQL = f"""{CD_SQL},
eq0 AS (
  SELECT district, count(*)::DOUBLE AS n_s, exp(avg(ln(beta_a) - ln(beta_w))) AS bx, avg(beta_k) AS mu_bk,
         avg(ln(budget_multiplier)) AS m_lambda, stddev_samp(ln(budget_multiplier)) AS s_lambda,
         sum(cost_kes) / nullif(sum(seed_kg), 0) / 1000 AS p_obs, sum(expected_yield * area) AS q_obs,
         avg(pow(budget_multiplier, {-ETA!r}::DOUBLE)) AS mu, stddev_samp(pow(budget_multiplier, {-ETA!r}::DOUBLE)) AS sig
  FROM cd GROUP BY district),
eq AS (SELECT *, q_obs * pow(p_obs, {-ETA_D!r}::DOUBLE) AS demand_factor FROM eq0)"""


def market_params(spark, d):
    lam = F.col("budget_multiplier")
    grouped = decomposed(spark, d).groupBy("district").agg(
        F.count(F.lit(1)).cast("double").alias("n_s"),
        F.exp(F.avg(F.ln("beta_a") - F.ln("beta_w"))).alias("bx"),
        F.avg("beta_k").alias("mu_bk"),
        F.avg(F.ln(lam)).alias("m_lambda"),
        F.stddev_samp(F.ln(lam)).alias("s_lambda"),
        (ratio(F.sum("cost_kes"), F.sum("seed_kg")) / 1000).alias("p_obs"),
        F.sum(F.col("expected_yield") * F.col("area")).alias("q_obs"),
        F.avg(F.pow(lam, F.lit(-ETA))).alias("mu"),
        F.stddev_samp(F.pow(lam, F.lit(-ETA))).alias("sig"),
    )
    return grouped.withColumn("demand_factor", P.demand_scale("p_obs", "q_obs", ETA_D))


@query(
    "demand_scale",
    f"""WITH {EQ_SQL} SELECT district, {rnd("p_obs", 6)} AS p_obs, {rnd("q_obs", 2)} AS q_obs,
        {rnd("demand_factor", 2)} AS demand_factor FROM eq""",
)
def demand_scale(spark, d):
    return _round(market_params(spark, d), {"p_obs": 6, "q_obs": 2, "demand_factor": 2}, "district")


def _scale_sql(bx: str, m: str, s: str) -> str:
    inside = sql_cdf(f"(({m} - ({log(H)!r}::DOUBLE)) / {s} - {ETA!r}::DOUBLE * {s})")
    return (
        f"(exp({-ETA!r}::DOUBLE * {m} + {ETA**2!r}::DOUBLE * {s} * {s} / 2) * {inside} "
        f"* pow({exp(1.0)!r}::DOUBLE * {bx}, {1 / (1 - H)!r}::DOUBLE))"
    )


EQ_A0 = 1.0
EQ_DIGITS = {"p_eq": 6, "log_q_eq": 6, "log_supply": 6, "log_demand": 6}
EQ_OUT_SQL = f"""{EQ_SQL},
dn AS (SELECT *, n_s * {_scale_sql("bx", "m_lambda", "s_lambda")} * mu_bk AS den FROM eq),
pq AS (
  SELECT *, pow(demand_factor / den, {1 / (ETA - ETA_D)!r}::DOUBLE) AS p_eq,
         ln(pow(pow(demand_factor, {ETA!r}::DOUBLE) / pow(den, {ETA_D!r}::DOUBLE), {1 / (ETA - ETA_D)!r}::DOUBLE)) AS log_q_eq
  FROM dn)"""


@query(
    "market_equilibrium",
    f"""WITH {EQ_OUT_SQL}, ou AS (SELECT *, ln(n_s * {_scale_sql("bx", "m_lambda", "s_lambda")}
          * pow(mu_bk * pow(p_obs, {H}::DOUBLE), {1 / (1 - H)!r}::DOUBLE)) AS log_supply,
          ln(demand_factor * pow(p_obs, {ETA_D}::DOUBLE)) AS log_demand FROM pq)
        SELECT district, {_rounded_sql(EQ_DIGITS)} FROM ou""",
)
def market_equilibrium(spark, d):
    eq = P.market_equilibrium(market_params(spark, d), H, EQ_A0, ETA_D)
    out = eq.withColumns(
        {
            "log_q_eq": F.ln("q_eq"),
            "log_supply": F.ln(P.market_supply(H, EQ_A0, F.col("p_obs"))),
            "log_demand": F.ln(P.market_demand(F.col("p_obs"), ETA_D, F.col("demand_factor"))),
        }
    )
    return _round(out, EQ_DIGITS, "district")


CURVES_DIGITS = {"p": 6, "log_quantity": 6}


@query(
    "supply_demand_curves",
    f"""WITH {EQ_SQL}, g AS (SELECT * FROM eq, {_axis_sql(0.1, 20.0, 40, "gi", "p")} x),
        c AS (SELECT district, p, 'Supply' AS kind, ln(n_s * {_scale_sql("bx", "m_lambda", "s_lambda")}
          * pow(mu_bk * pow(p, {H}::DOUBLE), {1 / (1 - H)!r}::DOUBLE)) AS log_quantity FROM g
        UNION ALL SELECT district, p, 'Demand', ln(demand_factor * pow(p, {ETA_D}::DOUBLE)) FROM g)
        SELECT district, kind, {_rounded_sql(CURVES_DIGITS)} FROM c""",
)
def supply_demand_curves(spark, d):
    g = with_grid(market_params(spark, d), "p", 0.1, 20.0, 40)
    wide = g.select(
        "district",
        "p",
        F.ln(P.market_supply(H, EQ_A0, F.col("p"))).alias("Supply"),
        F.ln(P.market_demand(F.col("p"), ETA_D, F.col("demand_factor"))).alias("Demand"),
    )
    long = wide.unpivot(["district", "p"], ["Supply", "Demand"], "kind", "log_quantity")
    return _round(long, CURVES_DIGITS, "district", "kind")


STATIC_DIGITS = {
    "p_e": 6,
    "y_e": 6,
    "revenue": 5,
    "elas_p_h": 6,
    "elas_y_h_partial": 6,
    "elas_y_h": 6,
    "profit": 5,
    "dprofit_dh": 5,
}
STATICS_SQL = f"""{EQ_SQL},
cs0 AS (
  SELECT district, {H}::DOUBLE AS h, ln(bx * mu_bk) + {EQ_A0} AS b, exp(m_lambda) AS lam, q_obs / n_s / 1000 AS dfac FROM eq),
cs1 AS (SELECT *, h / (1 - h) AS eta_s FROM cs0),
cs2 AS (SELECT *, pow(dfac * exp(-b / (1 - h)), 1 / (eta_s - ({ETA_D}::DOUBLE))) AS p_e FROM cs1),
cs3 AS (SELECT *, exp(b / (1 - h)) * pow(p_e / lam, eta_s) AS y_e FROM cs2),
cs4 AS (
  SELECT *, p_e * y_e AS revenue, -h / ((eta_s - ({ETA_D}::DOUBLE)) * pow(1 - h, 2)) * (b + ln(p_e)) AS elas_p_h,
         h / pow(1 - h, 2) * (b + ln(p_e / lam)) AS elas_y_h_partial FROM cs3),
cs AS (
  SELECT *, elas_y_h_partial + eta_s * elas_p_h AS elas_y_h, revenue * (1 - h) AS profit,
         revenue * (elas_y_h_partial / eta_s - 1) AS dprofit_dh FROM cs4)"""


@query("comparative_statics", f"WITH {STATICS_SQL} SELECT district, {_rounded_sql(STATIC_DIGITS)} FROM cs")
def comparative_statics(spark, d):
    rows = market_params(spark, d).select(
        "district",
        F.lit(H).alias("h"),
        (F.ln(F.col("bx") * F.col("mu_bk")) + EQ_A0).alias("b"),
        F.exp("m_lambda").alias("lam"),
        (F.col("q_obs") / F.col("n_s") / 1000).alias("demand_factor"),
    )
    return _round(P.comparative_statics(rows, ETA_D), STATIC_DIGITS, "district")


@query(
    "participation_supply",
    f"""WITH {EQ_SQL}, ps AS (SELECT *, sqrt(ln(pow(sig / mu, 2) + 1)) AS sl,
          ln(mu) - ln(pow(sig / mu, 2) + 1) / 2 AS ml FROM eq),
        pt AS (SELECT *, n_s * {sql_cdf(f"((({-ETA!r}::DOUBLE * ln({H}::DOUBLE)) - ml) / sl)")} AS participants FROM ps)
        SELECT district, {rnd("participants", 6)} AS participants,
        {rnd(f"exp(ln(bx * mu_bk) / {1 - H}) * pow(p_obs, {ETA!r}::DOUBLE) * participants", 6)} AS supply FROM pt""",
)
def participation_supply(spark, d):
    rows = market_params(spark, d).withColumn("b", F.ln(F.col("bx") * F.col("mu_bk")))
    out = P.participation_supply(rows, H, F.col("p_obs"))
    return _round(out, {"participants": 6, "supply": 6}, "district")


# ------------------------------------------------------------------------ forecasts against statistics


@query(
    "forecast_vs_actual",
    f"""WITH {MONTHLY_SQL}, ch AS (SELECT *, ln(price) - lag(ln(price)) OVER (PARTITION BY market ORDER BY date) AS dl
          FROM monthly),
        s AS (SELECT market, CAST(year(date) - CASE WHEN month(date) < 3 THEN 1 ELSE 0 END AS INTEGER) AS season,
          avg(dl) AS m FROM ch GROUP BY 1, 2),
        f AS (SELECT season + 1 AS yr, avg(m) AS drift FROM s GROUP BY season),
        a AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, avg(o_totalprice) AS actual FROM orders GROUP BY 1),
        p AS (SELECT a.yr, b.actual * exp(f.drift * 12) AS forecast, a.actual FROM a JOIN a b ON b.yr = a.yr - 1
          JOIN f ON f.yr = a.yr)
        SELECT yr, {rnd("forecast", 3)} AS forecast, {rnd("actual", 3)} AS actual, {rnd("forecast - actual", 3)} AS diff,
        {rnd("100 * (forecast - actual) / nullif(actual, 0)", 6)} AS diff_pct FROM p""",
)
def forecast_vs_actual(spark, d):
    """Last year's level carried forward by last season's drift, against this year's level."""
    drift = season_drift(monthly_prices(spark, d), "market", 3, 12)
    yearly_drift = drift.groupBy((F.col("season") + 1).alias("yr")).agg(F.avg("m").alias("drift"))
    actual = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(
        F.avg("o_totalprice").alias("actual")
    )
    previous = actual.select((F.col("yr") + 1).alias("yr"), F.col("actual").alias("last"))
    joined = actual.join(previous, "yr").join(yearly_drift, "yr")
    out = P.forecast_difference(joined.withColumn("forecast", F.col("last") * F.exp(F.col("drift") * 12)))
    return _round(out, {"forecast": 3, "actual": 3, "diff": 3, "diff_pct": 6}, "yr")


#: Forecasts are made for one rainfall a year; recorded totals are in short tons, the curve in tons.
RAIN_OF_YEAR = list(P.RAINFALL)
FORECAST_SCALE = N_FARMS * 1e-12 / 1.10231131
ON_DIGITS = {"forecast": 8, "p_at": 3, "gap_pct": 4}


@query(
    "forecast_on_curve",
    f"""WITH RECURSIVE {CURVE_SQL},
        fc AS (SELECT c_nationkey AS district, CAST(year(o_orderdate) AS INTEGER) AS yr, avg(o_totalprice) * {FORECAST_SCALE!r}::DOUBLE AS forecast,
          {RAIN_OF_YEAR}[year(o_orderdate) % {len(RAIN_OF_YEAR)} + 1] AS rainfall
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        sg AS (SELECT *, lead(p) OVER w AS p1, lead(supply_mmt) OVER w AS y1, min(supply_mmt) OVER a AS low, max(supply_mmt) OVER a AS high,
          last_value(p) OVER a AS top FROM curve
          WINDOW w AS (PARTITION BY district, rainfall ORDER BY p), a AS (PARTITION BY district, rainfall ORDER BY p
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        mt AS (SELECT fc.district, fc.rainfall, yr, forecast,
          CASE WHEN forecast < max(low) THEN 'below' WHEN forecast > max(high) THEN 'above' WHEN max(low) IS NOT NULL THEN 'on' END AS position,
          coalesce(min(CASE WHEN forecast BETWEEN supply_mmt AND y1
            THEN p + CASE WHEN y1 = supply_mmt THEN 0 ELSE (forecast - supply_mmt) / (y1 - supply_mmt) END * (p1 - p) END),
            max(CASE WHEN forecast = high THEN top END)) AS p_at
          FROM fc LEFT JOIN sg ON fc.district = sg.district AND fc.rainfall = sg.rainfall GROUP BY 1, 2, 3, 4)
        SELECT mt.district, rainfall, yr, position, {rnd("forecast", 8)} AS forecast, {rnd("p_at", 3)} AS p_at,
        {rnd("100 * (p_at / price - 1)", 4)} AS gap_pct FROM mt LEFT JOIN unc ON mt.district = unc.district""",
)
def forecast_on_curve(spark, d):
    """Each district's published yearly forecast on its supply curve: the price it implies, against the expected one."""
    years = table(spark, d, "orders").select(F.col("o_custkey").alias("hhid"), F.year("o_orderdate").alias("yr"), "o_totalprice")
    homes = table(spark, d, "customer").select(F.col("c_custkey").alias("hhid"), F.col("c_nationkey").alias("district"))
    level = F.element_at(F.array(*[F.lit(k) for k in RAIN_OF_YEAR]), F.col("yr") % len(RAIN_OF_YEAR) + 1)
    forecasts = (
        dimension_join(years, homes, ["hhid"])
        .groupBy("district", "yr")
        .agg((F.avg("o_totalprice") * F.lit(FORECAST_SCALE)).alias("forecast"))
        .withColumn("rainfall", level)
    )
    tabulated = P.materialise(curve(spark, d).select("district", "rainfall", "p", "supply_mmt", "price"))
    met = P.forecast_on_curve(forecasts, tabulated, ["district", "rainfall"], "forecast", "p", "supply_mmt")
    prices = tabulated.groupBy("district").agg(F.max("price").alias("price"))
    out = dimension_join(met, prices, ["district"], "left").withColumn("gap_pct", 100 * (ratio("p_at", "price") - 1))
    return _round(out, ON_DIGITS, "district", "rainfall", "yr", "position")


CALIB_POWER = -KAPPA_RAIN * ETA / H


@query(
    "calibrated_farms",
    f"""WITH RECURSIVE {MARKET_SQL}, {_risk_sql("unc", (1.0, 1.0, 1), None)},
        ds AS (SELECT district, avg(seed) AS ms FROM dfarms GROUP BY district),
        kr AS (SELECT f.district, avg(pow(f.seed / ds.ms, {CALIB_POWER!r}::DOUBLE)) AS kf, sum(harvest_kg) AS q
               FROM dfarms f JOIN ds ON f.district = ds.district GROUP BY f.district)
        SELECT r.district, {rnd(f"ln(kr.q * kr.kf * 1e-9 / (r.supply / {N_FARMS!r}::DOUBLE))", 6)} AS log_n_farms
        FROM risk r JOIN kr ON r.district = kr.district""",
)
def calibrated_farms(spark, d):
    """Number of farms (logged) at which modelled supply equals the recorded output of each district."""
    # the mean of (seed / mean seed)^power needs no second pass: the mean factors out
    recorded = {
        "rain_factor": F.avg(F.pow("seed", F.lit(CALIB_POWER))) / F.pow(F.avg("seed"), F.lit(CALIB_POWER)),
        "output": F.sum("harvest_kg"),
    }
    per_farm = P.supply_with_risk(markets(spark, d, recorded), H, 1.0, KAPPA_RAIN, M_P, S_P, HORIZON, (1.0, 1.0, 1))
    calibrated = P.calibrate_population(per_farm).withColumn("log_n_farms", log_positive("n_farms"))
    return _round(calibrated, {"log_n_farms": 6}, "district")
