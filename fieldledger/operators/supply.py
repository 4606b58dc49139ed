"""Strata, expected supply, interventions and market equilibrium, in closed form per row.

Farm tables are aggregated to strata or markets first; everything after that works on those few rows
and on scenario grids generated next to them.

Names: ``h`` is the yield degree of homogeneity and ``eta = h / (1 - h)``; ``m_unit, s_unit`` are the log
moments of the implicit unit expenditure; ``mk, sk, mu_k`` describe the controls; ``v`` is the
expenditure productivity of a stratum.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.functions.linear import linear_score, masked_dot
from fieldledger.functions.normal import lognormal_power_mean, norm_cdf, norm_pdf, spark_double
from fieldledger.functions.nulls import as_col, log_positive, ratio
from fieldledger.operators.joins import dimension_join, with_grid, with_levels, with_scalars
from fieldledger.operators.lineage import materialise
from fieldledger.operators.truncation import untruncate_upper

# Rainfall relative to the benchmark in the supply curve.
RAINFALL = {"normal": 1.0, "high": 1.5, "low": 0.5, "dismal": 0.1}


def eta_of(h: float) -> float:
    return h / (1 - h)


def control_moments(coefs: dict[str, float]) -> tuple[Column, Column]:
    """Aggregates for the mean and deviation of the summed, independent logged controls."""
    mean = sum((F.avg(F.col(c) * F.lit(b)) for c, b in coefs.items()), F.lit(0.0))
    var = sum((F.var_samp(F.col(c) * F.lit(b)) for c, b in coefs.items()), F.lit(0.0))
    return mean, F.sqrt(var)


def product_lognormal_mean(df: DataFrame, coefs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Mean of a product of independent lognormal controls: ``mk, sk, mu_k`` from one aggregate."""
    mk, sk = control_moments(coefs)
    return (
        df.groupBy(*(keys or []))
        .agg(mk.alias("mk"), sk.alias("sk"))
        .withColumn("mu_k", lognormal_power_mean("mk", "sk", F.lit(1.0)))
    )


def strata_table(farms: DataFrame, controls: dict[str, float], h: float) -> DataFrame:
    """One row per endowment label, ordered by ``v``, plus a ``Sample`` row of the same layout.

    ``farms`` has ``label, log_v, log_cost, yield, area`` and the logged controls. One grouping-sets pass
    gives the labels and the whole sample; the few resulting rows are kept, since what follows reads
    them several times. ``price`` is the highest implicit unit expenditure of the row's farms.
    """
    score = linear_score(controls)
    base = farms.select(
        "label",
        "log_cost",
        "yield",
        "area",
        *controls,
        F.exp("log_v").alias("v"),
        F.exp(score).alias("k"),
        F.exp((1 - h) * F.col("log_cost") - score - F.col("log_v")).alias("unit"),
    )
    mk, sk = control_moments(controls)
    rows = base.groupingSets([[F.col("label")], []], F.col("label")).agg(
        F.grouping("label").alias("_all"),
        F.avg("v").alias("_mean_v"),
        F.max("v").alias("_v"),
        F.avg("log_cost").alias("m_cost"),
        F.stddev_samp("log_cost").alias("s_cost"),
        F.avg("yield").alias("mean_yield"),
        F.avg("k").alias("mean_k"),
        F.avg("area").alias("mean_area"),
        F.max("unit").alias("price"),
        F.count(F.lit(1)).alias("n"),
        mk.alias("_mk"),
        sk.alias("_sk"),
    )
    rows = materialise(rows)
    whole = F.col("_all") == 1
    sample = rows.filter(whole).select(F.col("_mk").alias("mk"), F.col("_sk").alias("sk"), F.col("n").alias("_total"))
    # as many rows as there are combinations of the 0/1 endowments
    order = F.row_number().over(Window.partitionBy("_all").orderBy("v", "label"))
    out = (
        with_scalars(rows, sample)
        .withColumn("v", F.when(whole, F.col("_mean_v")).otherwise(F.col("_v")))
        .withColumns(
            {
                "mu_k": lognormal_power_mean("mk", "sk", F.lit(1.0)),
                "frac": F.col("n") / F.col("_total"),
                "stratum": F.when(whole, F.lit("All")).otherwise(order.cast("string")),
                "label": F.when(whole, F.lit("Sample")).otherwise(F.col("label")),
            }
        )
    )
    return _with_unit_cost(out.drop("_all", "_mean_v", "_v", "_mk", "_sk", "_total"), h)


def _with_unit_cost(df: DataFrame, h: float) -> DataFrame:
    var_unit = F.pow((1 - h) * F.col("s_cost"), 2) - F.pow("sk", 2)
    return (
        df.withColumns(
            {
                "mu_cost": lognormal_power_mean("m_cost", "s_cost", F.lit(1.0)),
                "mu_cost_h": lognormal_power_mean("m_cost", "s_cost", F.lit(h)),
                "m_unit": (1 - h) * F.col("m_cost") - F.col("mk") - F.ln("v"),
                "s_unit": F.when(var_unit > 0, F.sqrt(var_unit)),
            }
        )
        .withColumn("mu_yield", F.col("v") * F.col("mu_k") * F.col("mu_cost_h"))
        .withColumn("mu_unit", lognormal_power_mean("m_unit", "s_unit", F.lit(1.0)))
    )


def market_table(
    farms: DataFrame, keys: list[str], controls: dict[str, float], h: float, more: dict[str, Column] | None = None
) -> DataFrame:
    """The sample row per market, with the highest unit expenditure as the market's price ceiling.

    ``more`` are further aggregates of the farms by name, taken in the same pass.
    """
    unit = F.exp((1 - h) * F.col("log_cost") - linear_score(controls) - F.col("log_v"))
    base = farms.withColumns({"v": F.exp("log_v"), "unit": unit})
    mk, sk = control_moments(controls)
    out = (
        base.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("v").alias("v"),
            F.avg("log_cost").alias("m_cost"),
            F.stddev_samp("log_cost").alias("s_cost"),
            F.max("unit").alias("price"),
            F.avg("area").alias("mean_area"),
            mk.alias("mk"),
            sk.alias("sk"),
            *[c.alias(name) for name, c in (more or {}).items()],
        )
        .withColumn("mu_k", lognormal_power_mean("mk", "sk", F.lit(1.0)))
    )
    return _with_unit_cost(out, h)


def unconditional(table: DataFrame, h: float, m: str = "m", s: str = "s") -> DataFrame:
    """Moments of cost and yield in the full population from the recovered unit-expenditure moments."""
    return (
        table.withColumns(
            {
                "m_c": (F.ln("v") + F.col("mk") + F.col(m)) / (1 - h),
                "s_c": F.sqrt(F.pow("sk", 2) + F.pow(s, 2)) / (1 - h),
            }
        )
        .withColumns(
            {
                "mu_c": lognormal_power_mean("m_c", "s_c", F.lit(1.0)),
                "mu_c_h": lognormal_power_mean("m_c", "s_c", F.lit(h)),
            }
        )
        .withColumn("mu_y", F.col("v") * F.col("mu_k") * F.col("mu_c_h"))
    )


def truncation_rates(table: DataFrame, h: float, price: str = "price") -> DataFrame:
    """Employment rate and adjusted probability of profit at a price."""
    at = (F.ln(price) - F.col("m")) / F.col("s")
    out = table.withColumn("_at", at).withColumn("_z", F.col("_at") - eta_of(h) * F.col("s"))
    return out.withColumns({"employment_rate": norm_cdf("_at"), "prob_profit": norm_cdf("_z")}).drop("_at", "_z")


def supply_curve(markets: DataFrame, h: float, n_farms: float, kappa_rain: float, lo: float, hi: float, n: int):
    """Expected supply (million tons) and price elasticity on a price grid, one row per rainfall level.

    The grid runs over multiples of each market's ``price``.
    """
    g = with_grid(markets, "fraction", lo, hi, n).withColumn("p", F.col("fraction") * F.col("price"))
    g = _profit_columns(g, F.lit(eta_of(h)))
    levels = F.array(
        *[F.struct(F.lit(k).alias("rainfall"), F.lit(r**kappa_rain).alias("rain_factor")) for k, r in RAINFALL.items()]
    )
    g = g.select("*", F.inline(levels))
    supply = F.col("mean_area") * n_farms * F.col("rain_factor") * F.col("mu_y") * F.col("prob_profit") * 1e-9
    return g.withColumn("supply_mmt", supply)


def _risk_z(h: float, m_p: float, s_p: float, horizon: float, p0: Column) -> Column:
    eta = eta_of(h)
    num = eta * F.ln(F.col("mu_unit_full") / p0) - (eta * m_p - eta**2 * s_p**2 / 2) * horizon
    return num / (eta * s_p * horizon**0.5)


def supply_with_risk(
    markets: DataFrame,
    h: float,
    n_farms: float,
    kappa_rain: float,
    m_p: float,
    s_p: float,
    horizon: float,
    fractions: tuple[float, float, int],
    rain: tuple[float, float, int] | None = None,
) -> DataFrame:
    """Supply against a fraction of the expected price, with price and price-risk elasticities.

    High and low supply double and halve the rainfall ratio. With ``rain`` the ratio itself runs over
    a grid, which gives the supply map.
    """
    eta = eta_of(h)
    g = with_grid(markets, "fraction", *fractions)
    g = with_grid(g, "rain_ratio", *rain) if rain else g.withColumn("rain_ratio", F.lit(1.0))
    p = F.col("fraction") * F.col("price")
    z = _risk_z(h, m_p, s_p, horizon, p * exp(-m_p * horizon))
    power = kappa_rain * eta / h
    out = g.withColumns({"p": p, "z": z}).withColumns(
        {
            "participation": norm_cdf("-z"),
            "base": F.col("mean_area") * n_farms * F.col("mu_y") * F.pow("fraction", F.lit(eta)) * 1e-9,
        }
    )
    base = F.col("base") * F.col("participation")
    hazard = ratio(norm_pdf("-z"), F.col("participation"))
    return out.withColumns(
        {
            "supply": base,
            "supply_high": base * F.pow(F.col("rain_ratio") * 2, F.lit(power)),
            "supply_low": base * F.pow(F.col("rain_ratio") / 2, F.lit(power)),
            "elasticity": eta + hazard / (s_p * horizon**0.5),
            "risk_elasticity": -hazard * (eta * s_p * horizon**0.5 - F.col("z")),
        }
    ).drop("base")


def homogeneity_sensitivity(markets: DataFrame, levels: list[float], lo: float, hi: float, n: int) -> DataFrame:
    """Employment rate, profit probability and elasticity on a price grid for several ``h``."""
    g = with_levels(with_grid(markets, "fraction", lo, hi, n), "h", [float(x) for x in levels])
    g = g.withColumns({"p": F.col("fraction") * F.col("price"), "eta": F.col("h") / (1 - F.col("h"))})
    return _profit_columns(g, F.col("eta"))


def _profit_columns(g: DataFrame, eta: Column) -> DataFrame:
    """Employment rate, profit probability and price elasticity at the row's price ``p``."""
    at = (F.ln("p") - F.col("m")) / F.col("s")
    g = g.withColumn("_at", at).withColumn("_z", F.col("_at") - eta * F.col("s"))
    g = g.withColumns({"employment_rate": norm_cdf("_at"), "prob_profit": norm_cdf("_z")})
    return g.withColumn("elasticity", ratio(norm_pdf("_z"), "prob_profit") / F.col("s")).drop("_at", "_z")


def adoption_ceiling(h: float, subsidy: Column, dln_nu: Column, dln_g: float) -> Column:
    """Highest expenditure at which adopting pays; NULL when the subsidy is not what decides."""
    net = dln_nu + dln_g
    return F.when(net < 0, ratio(-h * subsidy, net))


def intervention_impact(strata: DataFrame, h: float, scenario: dict[str, float], n_farms: float) -> DataFrame:
    """Adoption, subsidy cost, welfare and supply change per stratum for one technology package.

    ``strata`` carries the unconditional moments and, from the sample row, ``mean_area, price,
    employment_rate, mu_return, mu_c_all``. ``scenario`` has ``dln_g, alpha_dlw, nu_ratio, subsidy``.
    """
    dln_p = -scenario["alpha_dlw"] * scenario["nu_ratio"]
    dln_nu = F.lit(dln_p - scenario["alpha_dlw"])
    dln_nu_h = F.lit(h * dln_p - scenario["alpha_dlw"])
    sub = F.lit(float(scenario["subsidy"]))
    return _impact(strata, h, scenario["dln_g"], dln_nu, dln_nu_h, sub, n_farms)


def policy_grid(
    strata: DataFrame,
    h: float,
    dln_g: float,
    nu_ratio: float,
    dlw: tuple[float, float, int],
    subsidy: tuple[float, float, int],
    n_farms: float,
    welfare_dln_nu: float | None = None,
) -> DataFrame:
    """Adoption rate, supply and welfare change on a price-change by subsidy grid, summed over strata.

    ``welfare_dln_nu`` fixes the price-ratio change in the welfare factor instead of the cell's own,
    which reproduces the published maps.
    """
    g = with_grid(with_grid(strata, "dlw", *dlw, index="i"), "subsidy", *subsidy, index="j")
    dln_nu = -F.col("dlw") * (1 + nu_ratio)
    dln_nu_h = -F.col("dlw") * (1 + h * nu_ratio)
    cells = _impact(g, h, dln_g, dln_nu, dln_nu_h, F.col("subsidy"), n_farms, welfare_dln_nu)
    cells = cells.withColumn("_nu", dln_nu)
    return _total_impact(cells, ["i", "j"], n_farms, F.first("_nu").alias("dln_nu"))


def intervention_total(impact: DataFrame, n_farms: float) -> DataFrame:
    """Whole-sample result: adoption from the sample's cost distribution, the rest summed over strata."""
    return _total_impact(impact, [], n_farms)


def _total_impact(cells: DataFrame, keys: list[str], n_farms: float, *extra: Column) -> DataFrame:
    return (
        cells.groupBy(*keys)
        .agg(
            *extra,
            F.first("subsidy").alias("subsidy"),
            F.first("adoption_all").alias("adoption_rate"),
            F.sum(F.col("frac") * F.col("adoption_rate")).alias("adoption_recombined"),
            F.sum("supply_change").alias("supply_change"),
            F.sum("welfare_change").alias("welfare_change"),
            F.first("mean_area").alias("_area"),
        )
        .withColumn("subsidy_cost", n_farms * F.col("_area") * F.col("subsidy") * F.col("adoption_rate") * 1e-6)
        .withColumn("net_welfare", F.col("welfare_change") - F.col("subsidy_cost"))
        .drop("_area")
    )


def _impact(
    df: DataFrame,
    h: float,
    dln_g: float,
    dln_nu: Column,
    dln_nu_h: Column,
    subsidy: Column,
    n_farms: float,
    welfare_dln_nu: float | None = None,
) -> DataFrame:
    for_welfare = dln_nu if welfare_dln_nu is None else F.lit(welfare_dln_nu)
    out = df.withColumns(
        {
            "subsidy": subsidy,
            "ceiling": adoption_ceiling(h, subsidy, dln_nu, dln_g),
            "_net": for_welfare + dln_g,
            "_net_h": dln_nu_h + dln_g,
        }
    )
    out = out.withColumns(
        {
            "_z": (F.ln("ceiling") - F.col("m_c")) / F.col("s_c"),
            "_z_all": (F.ln("ceiling") - F.col("m_c_all")) / F.col("s_c"),
        }
    )
    farms = F.col("frac") * n_farms * F.col("mean_area")
    rate = norm_cdf("_z")
    gain = F.col("mu_c_all") * norm_cdf("(_z - s_c)") - F.col("ceiling") * rate
    return out.withColumns(
        {
            "adoption_rate": rate,
            "adoption_all": norm_cdf("_z_all"),
            "subsidy_cost": farms * F.col("subsidy") * rate * 1e-6,
            "welfare_change": farms * F.col("_net") * F.col("mu_return") * F.col("employment_rate") * gain * 1e-6,
            "supply_change": farms
            * F.col("mu_y")
            * F.col("_net_h")
            / (1 - h)
            * norm_cdf(f"(_z - {spark_double(h)} * s_c)")
            * 1e-6,
        }
    ).drop("_net", "_net_h", "_z", "_z_all")


def shift_supply(curve: DataFrame, supply: str, change: DataFrame) -> DataFrame:
    """Supply curve moved by the supply change of a one-row table ``supply_change`` (thousand tons)."""
    moved = with_scalars(curve, change.select("supply_change"))
    return moved.withColumn("supply_shifted", F.col(supply) + F.col("supply_change") * 1e-3)


def strata_recombine(rate: str, frac: str = "frac") -> Column:
    """Weighted total of a stratum rate."""
    return F.sum(F.col(rate) * F.col(frac))


def effective_h(coefs: dict[str, float]) -> Column:
    """Sum of the technology coefficients of the inputs a farm uses."""
    return masked_dot(coefs)


def optimal_area(kappa_area: float, h: Column | str) -> Column:
    return ratio(F.lit(1 + kappa_area), h)


def cobb_douglas(
    df: DataFrame,
    intercept: float,
    inputs: dict[str, tuple[float, str]],
    controls: dict[str, float],
    cost: str,
    price: str,
) -> DataFrame:
    """Decompose productivity and evaluate the expected yield of each farm.

    ``inputs`` maps a quantity column to its coefficient and its price column; ``controls`` are logged.
    Adds ``h, beta_a, beta_k, beta_w, beta, expected_yield, budget_multiplier, area_opt`` terms.
    """
    use = {x: F.when(F.col(x) != 0, 1.0).otherwise(0.0) for x in inputs}
    log_a = sum((u * F.lit(inputs[x][0] * log(inputs[x][0])) for x, u in use.items()), F.lit(0.0))
    log_w = sum(
        (u * F.lit(inputs[x][0]) * F.coalesce(log_positive(inputs[x][1]), F.lit(0.0)) for x, u in use.items()),
        F.lit(0.0),
    )
    out = df.withColumns(
        {
            "h": effective_h({x: a for x, (a, _) in inputs.items()}),
            "beta_a": F.exp(log_a),
            "beta_w": F.exp(log_w),
            "beta_k": F.exp(linear_score(controls)),
        }
    ).withColumn("beta", F.col("beta_a") * F.col("beta_k") / F.col("beta_w"))
    scale = F.lit(exp(intercept)) * F.col("beta")
    spend = ratio(cost, "h")
    return out.withColumns(
        {
            "expected_yield": scale * F.pow(spend, F.col("h")),
            "budget_multiplier": scale * as_col(price) * F.pow(spend, F.col("h") - 1),
        }
    )


def supply_scale(h: float, a0: float) -> Column:
    """Participation-adjusted mean of the budget multiplier's power in the closed-form supply.

    Reads ``bx, m_lambda, s_lambda`` of the row.
    """
    eta = eta_of(h)
    m, s = F.col("m_lambda"), F.col("s_lambda")
    z = f"((m_lambda - ({spark_double(log(h))})) / s_lambda - {spark_double(eta)} * s_lambda)"
    scale = F.exp(-eta * m + eta**2 * s * s / 2) * norm_cdf(z)
    return scale * F.pow(F.lit(exp(a0)) * F.col("bx"), F.lit(1 / (1 - h)))


def market_supply(h: float, a0: float, price: Column) -> Column:
    """Quantity supplied at a price from ``n_s, bx, mu_bk, m_lambda, s_lambda`` of the row."""
    scale = supply_scale(h, a0)
    return F.col("n_s") * scale * F.pow(F.col("mu_bk") * F.pow(price, F.lit(h)), F.lit(1 / (1 - h)))


def market_demand(price: Column, eta_d: float, scale: Column) -> Column:
    return scale * F.pow(price, F.lit(eta_d))


def market_equilibrium(markets: DataFrame, h: float, a0: float, eta_d: float) -> DataFrame:
    """Equilibrium price and quantity per market; the row's ``demand_factor`` scales demand."""
    gap = eta_of(h) - eta_d
    denom = F.col("n_s") * supply_scale(h, a0) * F.col("mu_bk")
    factor = F.col("demand_factor")
    return markets.withColumn("_d", denom).withColumns(
        {
            "p_eq": F.pow(factor / F.col("_d"), F.lit(1 / gap)),
            "q_eq": F.pow(F.pow(factor, F.lit(eta_of(h))) / F.pow("_d", F.lit(eta_d)), F.lit(1 / gap)),
        }
    ).drop("_d")


def demand_scale(price: Column | str, quantity: Column | str, eta_d: float) -> Column:
    """Demand factor that makes the demand curve pass through an observed price and quantity."""
    return as_col(quantity) * F.pow(as_col(price), F.lit(-eta_d))


def comparative_statics(markets: DataFrame, eta_d: float, fixed_cost: float = 0.0) -> DataFrame:
    """Equilibrium price, yield and revenue of a farm and their elasticities in ``h``.

    Rows carry ``h, b, lam, demand_factor`` (demand over supply scale per farm).
    """
    c = F.col
    out = markets.withColumn("eta_s", c("h") / (1 - c("h")))
    p_e = F.pow(c("demand_factor") * F.exp(-c("b") / (1 - c("h"))), 1 / (c("eta_s") - eta_d))
    out = out.withColumn("p_e", p_e).withColumn(
        "y_e", F.exp(c("b") / (1 - c("h"))) * F.pow(c("p_e") / c("lam"), c("eta_s"))
    )
    out = out.withColumns(
        {
            "revenue": c("p_e") * c("y_e"),
            "elas_p_h": -c("h") / ((c("eta_s") - eta_d) * F.pow(1 - c("h"), 2)) * (c("b") + F.ln("p_e")),
            "elas_y_h_partial": c("h") / F.pow(1 - c("h"), 2) * (c("b") + F.ln(c("p_e") / c("lam"))),
        }
    )
    return out.withColumns(
        {
            "elas_y_h": c("elas_y_h_partial") + c("eta_s") * c("elas_p_h"),
            "profit": c("revenue") * (1 - c("h")) + c("lam") * fixed_cost,
            "dprofit_dh": c("revenue") * (c("elas_y_h_partial") / c("eta_s") - 1),
        }
    )


def participation_supply(markets: DataFrame, h: float, price: Column) -> DataFrame:
    """Participants and supply when the level has mean ``mu`` and deviation ``sig`` (lognormal)."""
    s2 = F.ln(F.pow(F.col("sig") / F.col("mu"), 2) + 1)
    upper = spark_double(-eta_of(h) * log(h))
    out = markets.withColumns({"s_lvl": F.sqrt(s2), "m_lvl": F.ln("mu") - s2 / 2})
    inside = norm_cdf(f"(({upper} - m_lvl) / s_lvl)")
    return out.withColumn("participants", F.col("n_s") * inside).withColumn(
        "supply", F.exp(F.col("b") / (1 - h)) * F.pow(price, F.lit(eta_of(h))) * F.col("participants")
    )


def recovered_strata(table: DataFrame, h: float) -> DataFrame:
    """Strata with unconditional moments: the sample row is untruncated and its moments used throughout.

    Takes the strata table and returns its strata without the sample row.
    """
    is_sample = F.col("stratum") == "All"
    sample = table.filter(is_sample)
    strata = table.filter(~is_sample).drop("price", "mean_area")
    full = untruncate_upper(sample, "m_unit", "s_unit", "price")
    facts = unconditional(full, h).select(
        F.col("m").alias("m_full"),
        F.col("s").alias("s_full"),
        F.col("mu_c").alias("mu_c_all"),
        F.col("m_c").alias("m_c_all"),
        "price",
        "mean_area",
        norm_cdf("((ln(price) - m) / s)").alias("employment_rate"),
        (F.col("price") * F.exp(-F.col("m_unit") + F.pow("s_unit", 2) / 2)).alias("mu_return"),
    )
    facts = materialise(facts)
    return unconditional(with_scalars(strata, facts), h, "m_full", "s_full")


def curve_segments(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """One row per tabulated curve: its stretches between neighbouring points in order of ``x``, and its range of ``y``.

    Points with a missing coordinate are left out; of points with one ``x`` the lower comes first. A curve has as many points as
    its grid, so its array is of that size whatever the data. The last point is a stretch of its own, so a single point is a curve too.
    """
    points = curve.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = points.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("_p"), F.min(y).alias("_low"), F.max(y).alias("_high")
    )
    n = F.size("_p")
    nexts = F.concat(F.slice("_p", F.lit(2), n - 1), F.slice("_p", n, F.lit(1)))
    return rows.select(*keys, F.zip_with("_p", nexts, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("_s"), "_low", "_high")


def forecast_on_curve(forecasts: DataFrame, curve: DataFrame, keys: list[str], target: str, x: str, y: str) -> DataFrame:
    """Where a tabulated curve meets each forecast: the lowest ``x`` at which its ``y`` is ``target``, between neighbouring points.

    Adds ``<x>_at`` and ``position``: ``on`` the curve, ``below`` or ``above`` its range, where ``<x>_at`` is NULL. A missing forecast or curve
    gives NULL in both. Every forecast meets one row, its curve's array, so neither side is repeated and frequent keys are the checked
    join's care.
    """
    rows = dimension_join(forecasts, curve_segments(curve, keys, x, y), keys, "left")
    t = F.col(target)

    def meets(s: Column) -> Column:
        return t.between(F.least(s["a"]["y"], s["b"]["y"]), F.greatest(s["a"]["y"], s["b"]["y"]))

    hit = F.get(F.filter("_s", meets), F.lit(0))
    rise = F.col("_h.b.y") - F.col("_h.a.y")
    share = F.when(rise == 0, 0.0).otherwise((t - F.col("_h.a.y")) / rise)
    position = F.when(t < F.col("_low"), "below").when(t > F.col("_high"), "above").when(t.isNotNull() & F.col("_low").isNotNull(), "on")
    return (
        rows.withColumn("_h", hit)
        .withColumns({f"{x}_at": F.col("_h.a.x") + share * (F.col("_h.b.x") - F.col("_h.a.x")), "position": position})
        .drop("_h", "_s", "_low", "_high")
    )


def forecast_difference(df: DataFrame) -> DataFrame:
    """Absolute and percentage difference of ``forecast`` from ``actual``."""
    diff = F.col("forecast") - F.col("actual")
    return df.withColumns({"diff": diff, "diff_pct": 100 * ratio(diff, "actual")})


def calibrate_population(df: DataFrame) -> DataFrame:
    """Farms needed for the supply of one farm (million tons) to add up to the recorded output (kg)."""
    return df.withColumn("n_farms", ratio(F.col("output") * F.col("rain_factor") * 1e-9, "supply"))

