import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.operators import supply as P
from fieldledger.operators import truncation as T
from fieldledger.operators.text import count_document_words

H = 0.25


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def dens(z):
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def truncated_upper(m, s, cut):
    z = (math.log(cut) - m) / s
    r = dens(z) / phi(z)
    return m - s * r, s * math.sqrt(1 - z * r - r * r)


@pytest.mark.parametrize("m,s,log_cut", [(2.0, 0.8, 2.5), (0.0, 1.0, 3.0), (1.0, 0.5, 0.2), (5.0, 0.3, 4.4), (0.0, 1.0, -3.0)])
def test_untruncate_round_trip(frame, m, s, log_cut):
    m_bar, s_bar = truncated_upper(m, s, math.exp(log_cut))
    df = frame([(m_bar, s_bar, math.exp(log_cut), -m_bar, math.exp(-log_cut))], "a double, b double, c double, na double, nc double")
    up = T.untruncate_upper(df, "a", "b", "c").first()
    assert (up.m, up.s) == (pytest.approx(m, abs=1e-5), pytest.approx(s, abs=1e-5))
    low = T.untruncate_lower(df, "na", "b", "nc").first()
    assert (low.m, low.s) == (pytest.approx(-m, abs=1e-5), pytest.approx(s, abs=1e-5))


def test_no_root_gives_null(frame):
    df = frame([(1.0, 1.0, math.exp(1.5)), (1.0, 0.0, 5.0), (None, 1.0, 5.0)], "a double, b double, c double")
    assert [r.s for r in T.untruncate_upper(df, "a", "b", "c").collect()] == [None, None, None]


def test_recovers_a_simulated_population(frame):
    x = np.random.default_rng(3).lognormal(2.0, 0.8, 60_000)
    x = x[x < math.exp(2.5)]
    df = frame([(float(v),) for v in x], "x double").agg(
        F.avg(F.ln("x")).alias("a"), F.stddev_samp(F.ln("x")).alias("b"), F.lit(math.exp(2.5)).alias("c")
    )
    r = T.untruncate_upper(df, "a", "b", "c").first()
    assert r.m == pytest.approx(2.0, abs=0.08) and r.s == pytest.approx(0.8, abs=0.05)


def stratum(frame, **extra):
    base = dict(
        label="Base", stratum="1", frac=1.0, mean_area=2.0, price=15.0, employment_rate=0.9, mu_return=14.0,
        m_c=9.0, s_c=1.0, mu_c=math.exp(9.5), mu_y=500.0, mu_c_all=math.exp(9.5), m_c_all=9.0,
    )
    base.update(extra)
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in base.items())
    return frame([tuple(base.values())], schema)


SCENARIO = {"dln_g": 0.3, "alpha_dlw": 0.2, "nu_ratio": 0.75, "subsidy": 1000.0}


def test_intervention_known_values(frame):
    r = P.intervention_impact(stratum(frame), H, SCENARIO, 1000.0).first()
    assert r.ceiling == pytest.approx(20000 * H)
    z = math.log(20000 * H) - 9.0
    assert r.adoption_rate == pytest.approx(phi(z))
    assert r.subsidy_cost == pytest.approx(1000 * 2 * 1000 * phi(z) * 1e-6)
    gain = math.exp(9.5) * phi(z - 1) - 5000 * phi(z)
    assert r.welfare_change == pytest.approx(2000 * -0.05 * 14 * 0.9 * gain * 1e-6)
    net_h = H * -0.15 - 0.2 + 0.3
    assert r.supply_change == pytest.approx(2000 * 500 * net_h / 0.75 * phi(z - H) * 1e-6)
    total = P.intervention_total(P.intervention_impact(stratum(frame), H, SCENARIO, 1000.0), 1000.0).first()
    assert total.adoption_rate == pytest.approx(total.adoption_recombined)


def test_ceiling_is_null_unless_the_net_change_is_negative(frame):
    same = dict(SCENARIO, dln_g=0.35)
    up = dict(SCENARIO, dln_g=0.5)
    for s in (same, up):
        r = P.intervention_impact(stratum(frame), H, s, 1000.0).first()
        assert r.ceiling is None or s is same and abs(r.ceiling) > 1e15
    assert P.intervention_impact(stratum(frame), H, up, 1000.0).first().adoption_rate is None


def test_policy_grid_cell_equals_single_scenario(frame):
    grid = P.policy_grid(stratum(frame), H, 0.3, 0.75, (0.2, 0.22, 3), (1000.0, 2000.0, 2), 1000.0)
    assert grid.count() == 6
    cell = grid.filter("i = 0 and j = 0").first()
    one = P.intervention_total(P.intervention_impact(stratum(frame), H, SCENARIO, 1000.0), 1000.0).first()
    for c in ("adoption_rate", "supply_change", "welfare_change", "net_welfare"):
        assert cell[c] == pytest.approx(one[c], rel=1e-9)
    fixed = P.policy_grid(stratum(frame), H, 0.3, 0.75, (0.2, 0.22, 3), (1000.0, 2000.0, 2), 1000.0, -0.35)
    a, b = (g.filter("i = 2 and j = 1").first() for g in (grid, fixed))
    assert a.welfare_change != pytest.approx(b.welfare_change) and a.supply_change == pytest.approx(b.supply_change)


def test_mean_yield_two_ways(frame):
    """Conditional mean yield times employment over profit probability is the unconditional mean."""
    m, s, cut = 1.0, 0.6, math.exp(1.4)
    m_bar, s_bar = truncated_upper(m, s, cut)
    df = frame([(3.0, 0.0, 0.0, 1.0, m_bar, s_bar, cut)], "v double, mk double, sk double, mu_k double, m_unit double, s_unit double, price double")
    full = P.unconditional(T.untruncate_upper(df, "m_unit", "s_unit", "price"), H)
    r = P.truncation_rates(full, H).first()
    x = np.random.default_rng(1).lognormal(m, s, 2_000_000)
    sample = x[x < cut]
    eta = H / (1 - H)
    level = 3.0 ** (1 / (1 - H))
    assert r.mu_y == pytest.approx(level * (x**eta).mean(), rel=0.01)
    conditional = level * (sample**eta).mean()
    # with yield proportional to cost^h, E[C^h | profit] = E[C^h] P(z - eta s shifted) / employment
    z = (math.log(cut) - m) / s
    assert conditional == pytest.approx(r.mu_y * phi(z - eta * s) / phi(z), rel=0.01)
    assert r.employment_rate == pytest.approx(phi(z)) and r.prob_profit == pytest.approx(phi(z - eta * s))


def test_supply_curve_is_increasing(frame):
    df = frame([("d", 2.0, 500.0, 1.0, 0.6, 5.0)], "k string, mean_area double, mu_y double, m double, s double, price double")
    out = P.supply_curve(df, H, 1e6, 0.6, 0.05, 3.0, 25).filter("rainfall = 'normal'").orderBy("p").collect()
    supply = [r.supply_mmt for r in out]
    assert supply == sorted(supply) and len(out) == 25
    assert supply[-1] == pytest.approx(2.0 * 1e6 * 500 * 1e-9, rel=0.05)
    # elasticity is the slope of log supply in log price
    a, b = out[10], out[11]
    slope = (math.log(b.supply_mmt) - math.log(a.supply_mmt)) / (math.log(b.p) - math.log(a.p))
    assert min(a.elasticity, b.elasticity) <= slope <= max(a.elasticity, b.elasticity)


def test_supply_map_rain_scaling(frame):
    df = frame([("d", 2.0, 500.0, 3.0, 5.0)], "k string, mean_area double, mu_y double, mu_unit_full double, price double")
    out = P.supply_with_risk(df, H, 1e6, 0.6, 0.02, 0.12, 5.0, (0.75, 1.2, 4), (0.2, 3.0, 5))
    assert out.count() == 20
    for r in out.collect():
        assert r.supply_high == pytest.approx(r.supply * (2 * r.rain_ratio) ** 0.8)
        assert r.supply_low == pytest.approx(r.supply * (r.rain_ratio / 2) ** 0.8)


def test_equilibrium_lies_on_demand_and_supply(frame):
    df = frame([(100.0, 2.0, 1.3, -0.2, 0.5, 5000.0)], "n_s double, bx double, mu_bk double, m_lambda double, s_lambda double, demand_factor double")
    eta_d = -0.98
    out = P.market_equilibrium(df, H, 0.1, eta_d).withColumn("d", P.market_demand(F.col("p_eq"), eta_d, F.col("demand_factor"))).first()
    assert out.q_eq == pytest.approx(out.d)
    eta = P.eta_of(H)
    inside = phi(-(math.log(H) + 0.2) / 0.5 - eta * 0.5)
    scale = 100 * (math.exp(0.1) * 2.0) ** (1 / (1 - H)) * 1.3 * math.exp(eta * 0.2 + eta**2 * 0.125) * inside
    assert out.q_eq == pytest.approx(scale * out.p_eq**eta)


def test_demand_scale_passes_through_the_point(frame):
    r = frame([(10.0, 1e10)], "p double, q double").select(P.demand_scale("p", "q", -0.98).alias("f")).first()
    assert r.f * 10**-0.98 == pytest.approx(1e10)


def test_comparative_statics_derivatives(frame):
    """The closed forms agree with numerical differentiation in h."""
    step = 1e-6
    rows = [(h, 0.8, 0.9, 4.0) for h in (0.3 - step, 0.3, 0.3 + step)]
    lo, mid, hi = P.comparative_statics(frame(rows, "h double, b double, lam double, demand_factor double"), -0.9).orderBy("h").collect()
    dp = (math.log(hi.p_e) - math.log(lo.p_e)) / (2 * step) * 0.3
    dy = (math.log(hi.y_e) - math.log(lo.y_e)) / (2 * step) * 0.3
    assert mid.elas_p_h == pytest.approx(dp, rel=1e-4) and mid.elas_y_h == pytest.approx(dy, rel=1e-4)


def test_cobb_douglas_terms(frame):
    df = frame([(2.0, 0.0, 3.0, 5.0, 0.5, 40.0, 7.0)], "x double, w double, px double, pw double, k double, c double, p double")
    r = P.cobb_douglas(df, 1.0, {"x": (0.2, "px"), "w": (0.1, "pw")}, {"k": 0.3}, "c", "p").first()
    assert r.h == pytest.approx(0.2)
    beta = math.exp(0.2 * math.log(0.2)) * math.exp(0.15) / math.exp(0.2 * math.log(3.0))
    assert r.beta == pytest.approx(beta) and r.expected_yield == pytest.approx(math.e * beta * 200**0.2)
    assert r.budget_multiplier == pytest.approx(math.e * beta * 7 * 200**-0.8)


def test_strata_are_single_valued_and_complete(frame):
    rows = [(lab, v, 8 + 0.1 * i + v, 100.0 + i, 0.1 * i, 1.0 + i) for i in range(10) for lab, v in (("A", 1.0), ("B", 1.5))]
    df = frame(rows, "label string, log_v double, log_cost double, yield double, k1 double, area double")
    out = {r.label: r for r in P.strata_table(df, {"k1": 0.2}, H).collect()}
    assert set(out) == {"A", "B", "Sample"} and (out["A"].stratum, out["B"].stratum, out["Sample"].stratum) == ("1", "2", "All")
    assert out["A"].frac == 0.5 and out["Sample"].frac == 1.0 and out["Sample"].n == 20
    assert out["Sample"].v == pytest.approx((math.e + math.exp(1.5)) / 2) and out["B"].v == pytest.approx(math.exp(1.5))
    k = [0.02 * i for i in range(10)] * 2
    assert out["A"].mk == pytest.approx(np.mean(k)) and out["A"].sk == pytest.approx(np.std(k, ddof=1))


MARKDOWN = """# Title *one*

Two words `r x + 1` here $a + b$ and $$c$$ end.
```{r chunk}
code <- 1
```
After \\[ z \\] chunk_end.
# References {-}
Not counted.
"""
LATEX = r"""\section{Intro} Some \textbf{bold} text $x^2$ here.
\begin{equation*} y = 1 \end{equation*} End {group}.
\section*{References}\label{references}
Gone.
"""


@pytest.mark.parametrize(
    "text,markdown,latex",
    [(MARKDOWN, 9, None), (LATEX, None, 5), ("", 0, 0), (" \n ", 0, 0), (" one ", 1, 1), ("```\nopen fence", 0, 3), ("two words", 2, 2)],
)
def test_word_counts(frame, text, markdown, latex):
    r = count_document_words(frame([(text,)], "text string")).first()
    assert markdown in (None, r.markdown_words) and latex in (None, r.latex_words)


def gap_and_factor(z):
    """z + r and sqrt(1 - r (z + r)) for any z, from the tail's continued fraction below -5."""
    if z < -5:
        g = 0.0
        for k in range(400, 0, -1):
            g = k / (-z + g)
        return g, math.sqrt(1 - (g - z) * g)
    r = dens(z) / phi(z)
    return z + r, math.sqrt(1 - r * (z + r))


@pytest.mark.parametrize("z", [-5000.0, -300.0, -35.0, -20.0, 0.0, 20.0, 100.0, 1000.0])
def test_root_is_found_wherever_it_lies(frame, z):
    g, factor = gap_and_factor(z) if z > -1000 else (-1 / z, -1 / z / (1 + 1 / z**2))
    s = 0.7
    df = frame([(1.0 - g * s, factor * s, math.exp(1.0))], "a double, b double, c double")
    r = T.untruncate_upper(df, "a", "b", "c").first()
    near = 1e-4 if z < -100 else 1e-6
    assert r.z == pytest.approx(z, rel=near, abs=1e-6) and r.s == pytest.approx(s, rel=near)
    assert r.m == pytest.approx(1.0 - z * s, rel=2 * near, abs=1e-5)


def test_no_truncation_gives_the_sample_moments(frame):
    r = T.untruncate_upper(frame([(2.0, 0.1, math.exp(12.0))], "a double, b double, c double"), "a", "b", "c").first()
    assert (r.m, r.s, r.z) == (pytest.approx(2.0), pytest.approx(0.1), pytest.approx(100.0))


def test_unclosed_inline_code_ends_with_its_line(frame):
    r = count_document_words(frame([("one `r x\ntwo three\nfour` five",)], "text string")).first()
    assert r.markdown_words == 7


def test_forecasts_on_a_tabulated_curve(frame):
    curve = frame(
        [("a", 1.0, 0.0), ("a", 2.0, 10.0), ("a", 3.0, 10.0), ("a", 5.0, 20.0), ("a", None, 99.0), ("a", 9.0, None), ("one", 7.0, 3.0)],
        "d string, p double, q double",
    )
    points = [("a", 5.0), ("a", 10.0), ("a", 15.0), ("a", 0.0), ("a", 20.0), ("a", -1.0), ("a", 21.0), ("a", None), ("one", 3.0), ("one", 4.0), ("none", 1.0), (None, 1.0), ("a", 5.0)]
    got = P.forecast_on_curve(frame(points, "d string, f double"), curve, ["d"], "f", "p", "q").collect()
    want = [1.5, 2.0, 4.0, 1.0, 5.0, None, None, None, 7.0, None, None, None, 1.5]
    where = ["on", "on", "on", "on", "on", "below", "above", None, "on", "above", None, None, "on"]
    expected = sorted(((*x, w, z) for x, w, z in zip(points, want, where)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == expected
    empty = P.forecast_on_curve(frame(points, "d string, f double"), curve.limit(0), ["d"], "f", "p", "q").collect()
    assert len(empty) == len(points) and {(r.p_at, r.position) for r in empty} == {(None, None)}
