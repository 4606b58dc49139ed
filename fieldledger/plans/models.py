"""Moments, distributions and regression queries."""

from __future__ import annotations

from fieldledger.functions import rounded
from fieldledger.operators import moments as M
from fieldledger.operators import regression as G
from fieldledger.operators.columns import transform_columns
from fieldledger.operators.lineage import materialise
from fieldledger.operators.supply import product_lognormal_mean
from fieldledger.plans import fit_sql as S
from fieldledger.plans.registry import query, rnd, sql_pdf
from fieldledger.plans.views import CONTROLS, DISTRICT_SQL, FARMS_SQL, farms, farms_by_district, table


@query(
    "group_moments",
    f"""SELECT event_type AS market, CAST(count(value) AS BIGINT) AS n, {rnd("avg(value)", 6)} AS mean,
        {rnd("stddev_samp(value)", 6)} AS sd FROM events GROUP BY event_type""",
)
def group_moments(spark, d):
    events = table(spark, d, "events").withColumnRenamed("event_type", "market")
    out = M.group_moments(events, ["market"], "value")
    return transform_columns(out, ["mean", "sd"], lambda c: rounded(c, 6))


LOGS_SQL = """
lg AS (
  SELECT user_id AS trader, CAST(count(x) AS BIGINT) AS n, avg(x) AS m, stddev_samp(x) AS s
  FROM (SELECT user_id, CASE WHEN value > 0 THEN ln(value) END AS x FROM events) GROUP BY user_id)"""


def quote_logs(spark, d):
    return table(spark, d, "events").withColumnRenamed("user_id", "trader")


@query(
    "lognormal_mean",
    f"WITH {LOGS_SQL} SELECT trader, n, {rnd('m', 6)} AS m, {rnd('s', 6)} AS s, {rnd('exp(m + s * s / 2)', 5)} AS mu FROM lg",
)
def lognormal_mean(spark, d):
    out = M.lognormal_summary(quote_logs(spark, d), ["trader"], "value")
    return out.select(
        "trader", "n", rounded("m", 6).alias("m"), rounded("s", 6).alias("s"), rounded("mu", 5).alias("mu")
    )


@query(
    "lognormal_power_mean",
    f"""WITH {LOGS_SQL} SELECT trader, {rnd("exp(m - s * s)", 6)} AS mode,
        {rnd("exp(0.25 * m + 0.0625 * s * s / 2)", 6)} AS power_mean FROM lg""",
)
def lognormal_power_mean(spark, d):
    out = M.lognormal_summary(quote_logs(spark, d), ["trader"], "value", 0.25)
    return out.select("trader", rounded("mode", 6).alias("mode"), rounded("power_mean", 6).alias("power_mean"))


@query(
    "logmeanexp_center",
    f"""WITH {FARMS_SQL}, c AS (SELECT ln(avg(exp(log_cost))) AS cc, ln(avg(exp(log_seed))) AS cs FROM farms)
        SELECT farm_id, {rnd("log_cost - cc", 6)} AS log_cost, {rnd("log_seed - cs", 6)} AS log_seed FROM farms, c""",
)
def logmeanexp_center(spark, d):
    cols = ["log_cost", "log_seed"]
    out = M.logmeanexp_center(farms(spark, d).select("farm_id", *cols), cols)
    return transform_columns(out, cols, lambda c: rounded(c, 6))


SUMMARY_VARS = ["yield", "cost", "area", "hybrid", "oxen"]
SUMMARY_DUMMIES = ["hybrid", "oxen"]


@query(
    "summary_table",
    f"WITH {FARMS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, '{s}' AS stat, {rnd(e.format(v), 3)} AS val FROM farms"
        for v in SUMMARY_VARS
        for s, e in (
            ("n", "count({})"),
            ("mean", "avg({})"),
            ("sd", "max(NULL::DOUBLE)" if v in SUMMARY_DUMMIES else "stddev_samp({})"),
            ("max", "max({})"),
            ("min", "min({})"),
        )
    ),
)
def summary_table(spark, d):
    out = M.summary_table(farms(spark, d), SUMMARY_VARS, SUMMARY_DUMMIES)
    return out.withColumn("val", rounded("val", 3))


BINS_SQL = """
span AS (SELECT l_returnflag AS kind, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
bins AS (
  SELECT kind, lo, hi, (hi - lo) / 20 AS w,
         least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 20)) AS INTEGER) + 1, 20) AS bin
  FROM lineitem JOIN span ON l_returnflag = kind)"""


@query(
    "histogram_bins",
    f"""WITH {BINS_SQL} SELECT kind, bin, CAST(count(*) AS BIGINT) AS n, {rnd("any_value(lo + (bin - 0.5) * (hi - lo) / 20)", 6)} AS mid
        FROM bins GROUP BY kind, bin""",
)
def histogram_bins(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "kind")
    out = M.histogram(rows, ["kind"], "l_extendedprice", 20)
    return out.select("kind", "bin", "n", rounded("mid", 6).alias("mid"))


@query(
    "density_overlay",
    f"""WITH ev AS (SELECT event_type AS market, value FROM events WHERE value > 0),
        f AS (SELECT market, count(*) AS n_fit, avg(ln(value)) AS m, stddev_samp(ln(value)) AS s,
              min(value) AS lo, max(value) AS hi FROM ev GROUP BY market),
        b AS (SELECT market, least(CAST(floor((value - lo) / ((hi - lo) / 15)) AS INTEGER) + 1, 15) AS bin, count(*) AS n
              FROM ev JOIN f USING (market) GROUP BY 1, 2),
        x AS (SELECT *, lo + (bin - 0.5) * (hi - lo) / 15 AS mid, (hi - lo) / 15 AS width FROM b JOIN f USING (market))
        SELECT market, bin, {rnd("n / (n_fit * width)", 8)} AS density,
        {rnd(sql_pdf("(ln(mid) - m) / s") + " / (mid * s)", 8)} AS fitted FROM x""",
)
def density_overlay(spark, d):
    events = table(spark, d, "events").withColumnRenamed("event_type", "market")
    out = M.density_overlay(events, ["market"], "value", 15)
    return out.select("market", "bin", rounded("density", 8).alias("density"), rounded("fitted", 8).alias("fitted"))


PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(
    "quantile_table",
    "WITH "
    + "q AS (SELECT event_type AS market, unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS prob, "
    + "unnest(quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95])) AS quantile FROM events GROUP BY event_type) "
    + f"SELECT market, prob, {rnd('quantile', 6)} AS quantile FROM q",
)
def quantile_table(spark, d):
    events = table(spark, d, "events").withColumnRenamed("event_type", "market")
    return M.quantile_table(events, ["market"], "value", PROBS).withColumn("quantile", rounded("quantile", 6))


CORR_VARS = ["log_yield", "log_cost", "log_area", "log_seed"]


@query(
    "correlation_matrix",
    f"WITH {FARMS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, {rnd(f'corr({a}, {b})', 6) if a != b else 'min(1.0::DOUBLE)'} AS r FROM farms"
        for a in CORR_VARS
        for b in CORR_VARS
    ),
)
def correlation_matrix(spark, d):
    return M.correlation_matrix(farms(spark, d), CORR_VARS).withColumn("r", rounded("r", 6))


REGRESSORS = ["log_cost", "log_area", "log_seed", "hybrid", "tenure", "oxen", "tractor"]


FIT_DIGITS = ["estimate", "std_error", "p_value", "r2", "r2_adj"]


@query(
    "ols_fit",
    f"""WITH RECURSIVE {FARMS_SQL}, {S.normal_equations("eq", "farms", "log_yield", REGRESSORS)},
        {S.eliminated("fit", "eq", len(REGRESSORS))} {S.fit_select("fit", "eq", REGRESSORS)}""",
)
def ols_fit(spark, d):
    out = G.ols_fit(farms(spark, d), "log_yield", REGRESSORS)
    return transform_columns(out, FIT_DIGITS, lambda c: rounded(c, 6))


@query(
    "ols_trim_refit_multi",
    f"""WITH RECURSIVE {FARMS_SQL}, {S.trimmed("near", "farms", "log_yield", REGRESSORS, 1.0)},
        {S.normal_equations("eq", "near", "log_yield", REGRESSORS)},
        {S.eliminated("fit", "eq", len(REGRESSORS))} {S.fit_select("fit", "eq", REGRESSORS)}""",
)
def ols_trim_refit_multi(spark, d):
    out = G.trim_refit_multi(farms(spark, d), "log_yield", REGRESSORS, 1.0)
    return transform_columns(out, FIT_DIGITS, lambda c: rounded(c, 6))


SELECTED = ["log_seed", "hybrid", "tenure", "oxen", "tractor"]
SELECTION_PARTS, SELECTION_SQL = S.selection("near", "log_yield", SELECTED, ["log_cost", "log_area"])


@query(
    "input_selection",
    f"""WITH RECURSIVE {FARMS_SQL}, {S.trimmed("near", "farms", "log_yield", [*SELECTED, "log_cost", "log_area"], 1.0)},
        {SELECTION_PARTS} {SELECTION_SQL}""",
)
def input_selection(spark, d):
    """Inputs that stay while those whose coefficient is not negative are dropped, after trimming."""
    out = G.input_selection(farms(spark, d), "log_yield", SELECTED, ["log_cost", "log_area"], 1.0)
    return transform_columns(out, ["first_estimate", "estimate"], lambda c: rounded(c, 6))


@query(
    "ols_two_regressors",
    f"""WITH {FARMS_SQL}, m AS (SELECT count(*)::DOUBLE AS n, avg(log_yield) AS my, avg(log_cost) AS ma, avg(log_area) AS mb,
          covar_pop(log_cost, log_cost) AS aa, covar_pop(log_area, log_area) AS bb, covar_pop(log_cost, log_area) AS ab,
          covar_pop(log_cost, log_yield) AS ay, covar_pop(log_area, log_yield) AS byy, covar_pop(log_yield, log_yield) AS yy
          FROM farms),
        f AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS sa,
          (aa * byy - ab * ay) / (aa * bb - ab * ab) AS sb FROM m),
        g AS (SELECT *, my - sa * ma - sb * mb AS b0, (sa * ay + sb * byy) / yy AS r2 FROM f)
        SELECT CAST(n AS BIGINT) AS n, {rnd("b0", 6)} AS intercept, {rnd("sa", 6)} AS slope_a, {rnd("sb", 6)} AS slope_b,
        {rnd("r2", 6)} AS r2, {rnd("1 - (1 - r2) * (n - 1) / (n - 3)", 6)} AS r2_adj,
        {rnd("sqrt(n * yy * (1 - r2) / (n - 3) * bb / det / n)", 6)} AS se_a,
        {rnd("sqrt(n * yy * (1 - r2) / (n - 3) * aa / det / n)", 6)} AS se_b FROM g""",
)
def ols_two_regressors(spark, d):
    out = G.ols_two(farms(spark, d), "log_yield", "log_cost", "log_area")
    return out.select("n", *[rounded(c, 6).alias(c) for c in out.columns if c != "n"])


GRAM_VARS = ["one", "log_cost", "log_area", "log_yield"]


@query(
    "ols_gram",
    f"WITH {FARMS_SQL}, f1 AS (SELECT 1.0::DOUBLE AS one, log_cost, log_area, log_yield FROM farms) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, {rnd(f'sum({a} * {b})', 3)} AS total FROM f1"
        for i, a in enumerate(GRAM_VARS)
        for b in GRAM_VARS[i:]
    ),
)
def ols_gram(spark, d):
    out = G.gram_table(farms(spark, d), "log_yield", ["log_cost", "log_area"])
    return out.withColumn("total", rounded("total", 3))


@query(
    "ols_no_intercept",
    f"""WITH {DISTRICT_SQL} SELECT district, CAST(count(*) AS BIGINT) AS n,
        {rnd("sum(log_cost * log_yield) / sum(log_cost * log_cost)", 6)} AS slope FROM dfarms GROUP BY district""",
)
def ols_no_intercept(spark, d):
    out = G.slope_through_origin(farms_by_district(spark, d), "log_yield", "log_cost", ["district"])
    return out.withColumn("slope", rounded("slope", 6))


FIT_COLUMNS = f"""CAST(count(*) AS BIGINT) AS n, {rnd("regr_slope(log_yield, log_cost)", 6)} AS slope,
    {rnd("regr_intercept(log_yield, log_cost)", 6)} AS intercept, {rnd("regr_r2(log_yield, log_cost)", 6)} AS r2,
    {rnd("1 - (1 - regr_r2(log_yield, log_cost)) * (count(*) - 1)::DOUBLE / nullif(count(*) - 2, 0)::DOUBLE", 6)} AS r2_adj,
    CAST(count(*) - 2 AS BIGINT) AS df"""


def _round_fit(df):
    return transform_columns(df, ["slope", "intercept", "r2", "r2_adj"], lambda c: rounded(c, 6))


@query("ols_simple", f"WITH {FARMS_SQL} SELECT {FIT_COLUMNS} FROM farms")
def ols_simple(spark, d):
    return _round_fit(G.simple_fit(farms(spark, d), "log_yield", "log_cost"))


@query("ols_by_group", f"WITH {FARMS_SQL} SELECT label, {FIT_COLUMNS} FROM farms GROUP BY label")
def ols_by_group(spark, d):
    return _round_fit(G.simple_fit(farms(spark, d), "log_yield", "log_cost", ["label"]))


RESIDUAL_SQL = """
fit AS (SELECT regr_slope(log_yield, log_cost) AS b, regr_intercept(log_yield, log_cost) AS a FROM farms),
res AS (SELECT farms.*, a + b * log_cost AS fitted, log_yield - (a + b * log_cost) AS residual FROM farms, fit)"""


@query("ols_trim_refit", f"WITH {FARMS_SQL}, {RESIDUAL_SQL} SELECT {FIT_COLUMNS} FROM res WHERE abs(residual) <= 1")
def ols_trim_refit(spark, d):
    return _round_fit(G.trim_refit(farms(spark, d), "log_yield", "log_cost", 1.0))


@query(
    "ols_trim_refit_by_group",
    f"""WITH {FARMS_SQL}, fit AS (SELECT label AS lab, regr_slope(log_yield, log_cost) AS b,
        regr_intercept(log_yield, log_cost) AS a FROM farms GROUP BY label)
        SELECT label, {FIT_COLUMNS} FROM farms JOIN fit ON label = lab
        WHERE abs(log_yield - (a + b * log_cost)) <= 1.5 GROUP BY label""",
)
def ols_trim_refit_by_group(spark, d):
    return _round_fit(G.trim_refit(farms(spark, d), "log_yield", "log_cost", 1.5, ["label"]))


@query(
    "residual_summary",
    f"""WITH {FARMS_SQL}, {RESIDUAL_SQL} SELECT CAST(count(*) AS BIGINT) AS n, {rnd("sum(residual * residual)", 4)} AS rss,
        {rnd("stddev_samp(residual)", 6)} AS sd_residual FROM res""",
)
def residual_summary(spark, d):
    out = G.residual_summary(farms(spark, d), "log_yield", "log_cost")
    return out.select("n", rounded("rss", 4).alias("rss"), rounded("sd_residual", 6).alias("sd_residual"))


@query(
    "smearing_backtransform",
    f"""WITH {FARMS_SQL}, {RESIDUAL_SQL}, sg AS (SELECT stddev_samp(residual) AS s FROM res)
        SELECT farm_id, {rnd("exp(fitted - 0.1::DOUBLE * log_seed + s * s / 2)", 3)} AS expected,
        {rnd("cost / exp(fitted - 0.1::DOUBLE * log_seed + s * s / 2)", 6)} AS unit_cost FROM res, sg""",
)
def smearing_backtransform(spark, d):
    out = G.smearing(farms(spark, d), "log_yield", "log_cost", "cost", ("log_seed", 0.1))
    return out.select("farm_id", rounded("expected", 3).alias("expected"), rounded("unit_cost", 6).alias("unit_cost"))


PCA_VARS = [*CORR_VARS, "hybrid", "tenure", "oxen", "tractor"]
PCA_PARTS, PCA_SQL = S.components("farms", PCA_VARS)


@query("pca_loadings", f"WITH RECURSIVE {FARMS_SQL}, {PCA_PARTS} {PCA_SQL}")
def pca_loadings(spark, d):
    out = G.pca_loadings(farms(spark, d), PCA_VARS)
    return transform_columns(out, ["loading", "rotated", "eigenvalue", "cum_share"], lambda c: rounded(c, 5))


@query(
    "logistic_cdf_fit",
    f"""WITH RECURSIVE {FARMS_SQL}, pct AS (SELECT list_transform(range(1, 101), lambda i: i / 100.0::DOUBLE) AS p),
        points AS (SELECT unnest(p) AS y, unnest(q) AS x FROM (SELECT quantile_cont(log_cost, [{", ".join(f"{i / 100}" for i in range(1, 101))}]) AS q FROM farms), pct),
        {S.newton("points")}
        SELECT unnest(['(intercept)', 'log_cost']) AS term, unnest([{rnd("b0", 5)}, {rnd("b1", 5)}]) AS estimate
        FROM (SELECT * FROM newton ORDER BY t DESC LIMIT 1)""",
)
def logistic_cdf_fit(spark, d):
    """Logistic curve through the empirical distribution function of logged expenditure."""
    probs = [i / 100 for i in range(1, 101)]
    # both passes of the selection read one written column
    cdf = M.quantile_table(materialise(farms(spark, d).select("log_cost")), [], "log_cost", probs)
    out = G.logistic_fit(cdf.withColumnRenamed("quantile", "log_cost"), "prob", "log_cost")
    return out.withColumn("estimate", rounded("estimate", 5))


@query(
    "product_lognormal_mean",
    f"""WITH {DISTRICT_SQL}, g AS (SELECT district, avg(log_area * -0.2::DOUBLE) + avg(log_seed * 0.1::DOUBLE) AS mk,
        sqrt(var_samp(log_area * -0.2::DOUBLE) + var_samp(log_seed * 0.1::DOUBLE)) AS sk FROM dfarms GROUP BY district)
        SELECT district, {rnd("mk", 6)} AS mk, {rnd("sk", 6)} AS sk, {rnd("exp(mk + sk * sk / 2)", 6)} AS mu_k FROM g""",
)
def product_lognormal_mean_query(spark, d):
    out = product_lognormal_mean(farms_by_district(spark, d), CONTROLS, ["district"])
    return transform_columns(out, ["mk", "sk", "mu_k"], lambda c: rounded(c, 6))
