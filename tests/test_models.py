import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.functions.student import student_p
from fieldledger.operators import moments as M
from fieldledger.operators import regression as G

RNG = np.random.default_rng(5)


def normal_table(frame, n=400):
    x = RNG.normal(size=(n, 2))
    y = 1.5 + 0.7 * x[:, 0] - 0.4 * x[:, 1] + RNG.normal(scale=0.3, size=n)
    return frame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double"), x, y


def test_ols_matches_numpy(frame):
    df, x, y = normal_table(frame)
    df = df.unionByName(frame([(None, 1.0, 2.0)], "a double, b double, y double"))
    fit = {r.term: r for r in G.ols_fit(df, "y", ["a", "b"]).collect()}
    design = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    resid = y - design @ beta
    s2 = resid @ resid / (len(y) - 3)
    se = np.sqrt(np.diag(s2 * np.linalg.inv(design.T @ design)))
    for i, t in enumerate(["(intercept)", "a", "b"]):
        assert fit[t].estimate == pytest.approx(beta[i], abs=1e-9)
        assert fit[t].std_error == pytest.approx(se[i], rel=1e-6)
        assert fit[t].n == len(y) and 0 <= fit[t].p_value < 1e-6
    two = G.ols_two(df, "y", "a", "b").first()
    assert (two.intercept, two.slope_a, two.slope_b) == tuple(pytest.approx(v, abs=1e-9) for v in beta)
    assert two.se_a == pytest.approx(se[1], rel=1e-6) and two.r2_adj == pytest.approx(fit["a"].r2_adj, abs=1e-9)


def test_p_value_is_two_sided_t(frame):
    # slope 0.1 with standard error sqrt(1.9 / 3 / 10), three degrees of freedom
    df = frame([(float(x), y) for x, y in zip(range(1, 6), [1.0, 0.0, 1.0, 0.0, 1.5])], "x double, y double")
    r = {f.term: f for f in G.ols_fit(df, "y", ["x"]).collect()}["x"]
    t = r.estimate / r.std_error
    # survival function of Student's t with 3 degrees of freedom in closed form
    u = t / math.sqrt(3)
    tail = 0.5 - (math.atan(u) + u / (1 + u * u)) / math.pi
    assert r.p_value == pytest.approx(2 * tail, rel=1e-6)


def exact_student_p(t, dof):
    if dof == 1:
        return 1 - 2 * math.atan(t) / math.pi
    if dof == 2:
        return 1 - t / math.sqrt(2 + t * t)
    if dof == 3:
        u = t / math.sqrt(3)
        return 1 - 2 * (math.atan(u) + u / (1 + u * u)) / math.pi
    # numerical integral of the density beyond t, in the angle whose tangent is t / sqrt(dof)
    x = np.linspace(math.atan(t / math.sqrt(dof)), math.pi / 2, 400_001)
    c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(math.pi)
    weights = np.where(np.arange(len(x)) % 2 == 1, 4, 2)
    weights[[0, -1]] = 1
    return 2 * np.exp(c) * (x[1] - x[0]) / 3 * (weights * np.cos(x) ** (dof - 1)).sum()


def test_student_p(frame):
    dofs, ts = [1, 2, 3, 4, 10, 57, 500, 3999, 4001, 20_000, 10**6], [0.0, 0.01, 0.1, 1.0, 1.7, 2.5, 8.0, 30.0]
    df = frame([(t, d) for d in dofs for t in ts] + [(-1.0, 3), (None, 3), (1.0, 0), (1e160, 7)], "t double, dof long")
    got = {(r.t, r.dof): r.p for r in df.select("t", "dof", student_p("t", "dof").alias("p")).collect()}
    for d in dofs:
        assert got[0.0, d] == 1.0
        for t in ts[1:]:
            assert got[t, d] == pytest.approx(exact_student_p(t, d), rel=1e-6, abs=1e-11), (t, d)
    assert got[-1.0, 3] == got[1.0, 3] and got[None, 3] is None and got[1.0, 0] is None and got[1e160, 7] == 0.0
    far = frame([(2.0, 10**12)], "t double, dof long").select(student_p("t", "dof").alias("p")).first().p
    assert far == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-9)


def test_redundant_dummies_are_dropped(frame):
    rows = [(float(i), i % 2, 1 - i % 2, 5.0, 2.0 * i + (i % 2) + 0.01 * ((i * 7) % 5)) for i in range(30)]
    df = frame(rows, "x double, d1 int, d2 int, k double, y double")
    fit = {r.term: r.estimate for r in G.ols_fit(df, "y", ["x", "d1", "d2", "k"]).collect()}
    assert set(fit) == {"x", "d1", "(intercept)"} and fit["x"] == pytest.approx(2.0, abs=0.01)


def test_score_equals_prediction(frame):
    df, x, y = normal_table(frame)
    fit = G.ols_fit(df, "y", ["a", "b"])
    scored = G.predict(df, fit)
    r = scored.agg(F.avg(F.col("y") - F.col("fitted")).alias("bias")).first()
    assert r.bias == pytest.approx(0.0, abs=1e-9)
    assert G.negative_terms(fit, ["a", "b"]) == (["a"], ["b"])


def test_no_intercept_fit(frame):
    df = frame([(1.0, 2.0), (2.0, 3.0), (None, 9.0)], "x double, y double")
    assert G.slope_through_origin(df, "y", "x").first().slope == pytest.approx(8 / 5)
    fit = G.ols_fit(df, "y", ["x"], intercept=False).first()
    assert (fit.term, fit.estimate) == ("x", pytest.approx(8 / 5))


def test_trim_and_refit(frame):
    pts = [(float(i), 2.0 * i) for i in range(20)] + [(10.0, 60.0)]
    df = frame(pts, "x double, y double")
    assert G.trim_refit(df, "y", "x", 10.0).first().slope == pytest.approx(2.0)
    by = G.trim_refit(df.withColumn("g", F.lit("k")), "y", "x", 10.0, ["g"]).first()
    assert (by.n, by.slope) == (20, pytest.approx(2.0))
    assert G.residual_summary(df.limit(20), "y", "x").first().rss == pytest.approx(0.0, abs=1e-12)


def test_pca_loadings(frame):
    base = RNG.normal(size=(500, 2))
    cols = np.column_stack([base[:, 0], base[:, 0] + 0.1 * RNG.normal(size=500), base[:, 1], base[:, 1] + 0.1 * RNG.normal(size=500)])
    df = frame([tuple(map(float, r)) for r in cols], "a double, b double, c double, d double")
    out = G.pca_loadings(df, ["a", "b", "c", "d"]).toPandas()
    assert out.component.max() == 2
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(cols.T)))[::-1]
    assert sorted(out.eigenvalue.unique(), reverse=True) == pytest.approx(values[:2], abs=1e-9)
    wide = out.pivot(index="variable", columns="component", values="rotated").to_numpy()
    raw = out.pivot(index="variable", columns="component", values="loading").to_numpy()
    # rotation keeps communalities and gives each variable one dominant component
    assert (wide**2).sum(axis=1) == pytest.approx((raw**2).sum(axis=1), abs=1e-8)
    assert (np.abs(wide).max(axis=1) > 0.95).all() and (np.abs(wide).min(axis=1) < 0.2).all()


def test_logistic_curve(frame):
    pts = [(x / 10, 1 / (1 + math.exp(-(0.5 + 2 * x / 10)))) for x in range(-20, 21)]
    fit = {r.term: r.estimate for r in G.logistic_fit(frame(pts, "x double, p double"), "p", "x").collect()}
    assert fit == {"(intercept)": pytest.approx(0.5, abs=1e-4), "x": pytest.approx(2.0, abs=1e-4)}


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_are_exact(frame, n):
    values = np.round(RNG.exponential(size=n), 2)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    df = frame([("g", float(v)) for v in values] + [("h", 3.0)] * 5 + [("h", None)], "g string, v double")
    got = {(r.g, r.prob): r.quantile for r in M.quantile_table(df, ["g"], "v", probs).collect()}
    for p in probs:
        assert got["g", p] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert got["h", p] == 3.0
    whole = {r.prob: r.quantile for r in M.quantile_table(df, [], "v", [0.5]).collect()}
    assert whole[0.5] == pytest.approx(np.quantile(np.append(values, [3.0] * 5), 0.5))


def test_quantiles_with_one_value_holding_most_rows(frame):
    values = [5.0] * 700 + [float(i) / 100 for i in range(300)]
    df = frame([("g", v) for v in values], "g string, v double")
    got = {r.prob: r.quantile for r in M.quantile_table(df, ["g"], "v", [0.1, 0.299, 0.3, 0.5]).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_histogram_edges(frame):
    df = frame([("a", float(v)) for v in (0, 1, 2, 10)] + [("b", 4.0), ("b", 4.0), ("c", None)], "g string, v double")
    got = sorted((r.g, r.bin, r.n) for r in M.histogram(df, ["g"], "v", 5).collect())
    assert got == [("a", 1, 2), ("a", 2, 1), ("a", 5, 1), ("b", 1, 2)]
    assert sum(r.n for r in M.histogram(df, [], "v", 3).collect()) == 6


def test_density_integrates_to_one(frame):
    df = frame([("g", float(v)) for v in RNG.lognormal(1.0, 0.5, 800)], "g string, v double")
    bars = M.density_overlay(df, ["g"], "v", 40).collect()
    assert sum(r.density * r.width for r in bars) == pytest.approx(1.0)
    assert sum(r.fitted * r.width for r in bars) == pytest.approx(1.0, abs=0.1)


def test_lognormal_moments_and_centering(frame):
    df = frame([("g", 1.0), ("g", math.e), ("g", 0.0), ("h", 5.0)], "g string, x double")
    got = {r.g: r for r in M.lognormal_summary(df, ["g"], "x", 0.5).collect()}
    s2 = 0.5
    assert got["g"].mu == pytest.approx(math.exp(0.5 + s2 / 2)) and got["g"].mode == pytest.approx(math.exp(0.5 - s2))
    assert got["g"].power_mean == pytest.approx(math.exp(0.25 + 0.25 * s2 / 2)) and got["h"].mu is None
    out = M.logmeanexp_center(frame([(0.0,), (1.0,)], "a double"), ["a"])
    assert sum(math.exp(r.a) for r in out.collect()) / 2 == pytest.approx(1.0)


def test_correlation_and_summary(frame):
    df = frame([(1.0, 2.0, 0), (2.0, 4.0, 1), (3.0, 6.5, 1), (None, 1.0, 0)], "a double, b double, d int")
    got = {(r.var_a, r.var_b): r.r for r in M.correlation_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1]) and got["a", "a"] == 1.0
    table = {(r.variable, r.stat): r.val for r in M.summary_table(df, ["a", "d"], ["d"]).collect()}
    assert table["a", "n"] == 3 and table["a", "sd"] == pytest.approx(1.0) and table["d", "sd"] is None


def test_order_keys_are_those_of_the_bits(frame):
    rnd = np.random.default_rng(4)
    values = [0.0, 5e-324, 2.2250738585072009e-308, 2.2250738585072014e-308, 1.0, 1.7976931348623157e308, math.inf, 0.1, 3.0]
    values += [2.0**e for e in range(-1060, 1024, 61)] + [np.nextafter(2.0**e, 0) for e in range(-1000, 1024, 37)]
    values += [float(v) for v in rnd.integers(1, 2**63 - 2**53, 300, dtype=np.int64).view(np.float64)]
    values = [v for v in map(float, values) if not math.isnan(v)]
    got = {r.v: r.k for r in M.with_order_key(frame([(v,) for v in values], "v double"), "v", "k").collect()}
    assert all(got[v] == int(np.array(v).view(np.int64)) for v in values)
    signed = M.with_order_key(frame([(-v,) for v in values] + [(math.nan,)], "v double"), "v", "k").collect()
    assert {(-r.v, -r.k) for r in signed if not math.isnan(r.v)} == set(got.items())
    assert max(signed, key=lambda r: r.k).v != max(signed, key=lambda r: r.k).v


@pytest.mark.parametrize("bound", [1, 5, 50])
def test_no_bucket_ranks_more_rows_than_its_bound(frame, bound):
    rnd = np.random.default_rng(6)
    # nearly all rows within a millionth of one value, and one value that holds a third of them
    values = [*(1000 + rnd.random(900) * 1e-3), *[1000.0005] * 500, *rnd.normal(size=100)]
    df = frame([("g", float(v)) for v in values] + [("h", -2.0)] * 300, "g string, v double")
    keyed = M.with_order_key(df.withColumnRenamed("v", "_v"), "_v", "_k")
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    found, shift, _ = M.wanted_buckets(keyed, ["g"], probs, bound)
    held = keyed.withColumn("_bucket", F.shiftright("_k", shift)).join(found, ["g", "_bucket"], "left_semi")
    sizes = held.groupBy("g", "_bucket").agg(F.count_distinct("_v").alias("n")).collect()
    assert shift < 48 and max(r.n for r in sizes) <= bound
    got = {(r.g, r.prob): r.quantile for r in M.quantile_table(df, ["g"], "v", probs, bound).collect()}
    for p in probs:
        assert got["g", p] == pytest.approx(np.quantile(values, p), rel=1e-14) and got["h", p] == -2.0


def test_quantiles_of_nothing(frame):
    df = frame([("g", None)], "g string, v double")
    assert M.quantile_table(df, ["g"], "v", [0.5]).collect() == [] == M.quantile_table(df, [], "v", [0.5]).collect()
