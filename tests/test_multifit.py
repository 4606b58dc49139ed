"""Multivariate fits, trimming by down-dating, selection by sign, rotations and Newton steps against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.operators import linalg
from fieldledger.operators import regression as G

XS = ["a", "b", "c", "d"]
DDL = "a double, b double, c double, d double, y double"


def table(frame, seed=3, n=500, far=25):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, 4)) * [1, 3, 0.2, 1] + [0, 40, -7, 1]
    y = 2 + x @ [0.8, -0.3, -2.0, 0.5] + 0.4 * rnd.normal(size=n)
    y[:far] += rnd.choice([-9, 9], far)
    return frame([tuple(map(float, (*r, v))) for r, v in zip(x, y)], DDL).repartition(4), x, y


def lstsq(x, y):
    design = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    resid = y - design @ beta
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * (resid @ resid) / (len(y) - design.shape[1]))
    return beta, se, resid


def check(rows, names, x, y):
    beta, se, _ = lstsq(x, y)
    got = {r.term: r for r in rows}
    assert set(got) == {"(intercept)", *names}
    for i, t in enumerate(["(intercept)", *names]):
        assert got[t].estimate == pytest.approx(beta[i], rel=1e-8, abs=1e-10)
        assert got[t].std_error == pytest.approx(se[i], rel=1e-7)
        assert got[t].n == len(y)


def test_fit_of_several_regressors(frame):
    df, x, y = table(frame)
    check(G.ols_fit(df, "y", XS).collect(), XS, x, y)


def test_trimmed_fit_equals_the_fit_on_the_rows_that_stay(frame):
    df, x, y = table(frame)
    _, _, resid = lstsq(x, y)
    stay = np.abs(resid) <= 2.0
    assert 0 < (~stay).sum() < 40
    check(G.trim_refit_multi(df.unionByName(frame([(None, 1.0, 1.0, 1.0, 99.0)], DDL)), "y", XS, 2.0).collect(), XS, x[stay], y[stay])
    # a limit that nothing exceeds
    check(G.trim_refit_multi(df, "y", XS, 1e9).collect(), XS, x, y)


def test_down_dating_loses_no_digits_far_from_zero(frame):
    df, x, y = table(frame)
    far = df.select(*[(F.col(c) + 1e6).alias(c) for c in XS], "y")
    _, _, resid = lstsq(x, y)
    stay = np.abs(resid) <= 2.0
    beta, _, _ = lstsq(x[stay], y[stay])
    got = {r.term: r.estimate for r in G.trim_refit_multi(far, "y", XS, 2.0).collect()}
    assert [got[c] for c in XS] == pytest.approx(beta[1:], rel=1e-6)


def test_trimming_scans_twice_and_refits_without_the_rows(spark, frame):
    df, *_ = table(frame)
    plan = G.trim_refit_multi(df, "y", XS, 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def plain_selection(x, y, names, inputs, sign):
    use, at, first = list(names), {}, None
    for step in range(1, len(inputs) + 1):
        beta, _, _ = lstsq(x[:, [names.index(n) for n in use]], y)
        est = dict(zip(use, beta[1:]))
        first = first or est
        wrong = [n for n in use if n in inputs and not sign * est[n] > 0]
        at.update(dict.fromkeys(wrong, step))
        use = [n for n in use if n not in wrong]
    beta, _, _ = lstsq(x[:, [names.index(n) for n in use]], y)
    return first, dict(zip(use, beta[1:])), at


@pytest.mark.parametrize("keep,sign", [("negative", -1), ("positive", 1)])
def test_inputs_are_dropped_until_the_signs_agree(frame, keep, sign):
    rnd = np.random.default_rng(17)
    n = 400
    base = rnd.normal(size=n)
    # correlated inputs: what one loses, another takes over, with a changed sign
    x = np.column_stack([base + 0.3 * rnd.normal(size=n), base + 0.3 * rnd.normal(size=n), -base + 0.5 * rnd.normal(size=n), rnd.normal(size=n)])
    y = x @ [1.0, -0.7, 0.4, -0.2] + 0.1 * rnd.normal(size=n)
    df = frame([tuple(map(float, (*r, v))) for r, v in zip(x, y)], DDL)
    first, final, at = plain_selection(x, y, XS, XS[:3], sign)
    got = {r.variable: r for r in G.input_selection(df, "y", XS[:3], XS[3:], keep=keep).collect()}
    assert [got[v].is_input for v in XS] == [True] * 3 + [False]
    for v in XS:
        assert got[v].first_estimate == pytest.approx(first[v], abs=1e-9)
        assert got[v].dropped_at == at.get(v, 0)
        assert got[v].estimate == (None if v in at else pytest.approx(final[v], abs=1e-9))
    assert len(at) > 0


def test_selection_in_one_step_with_trimming_and_repeated_columns(frame):
    df, x, y = table(frame)
    twice = df.withColumn("e", F.col("a") * 2)
    got = {r.variable: r for r in G.input_selection(twice, "y", ["b", "a", "e"], ["c", "d"], limit=2.0, steps=1).collect()}
    # a is positive and goes; e repeats it, has no estimate of its own, and goes with it
    assert got["a"].dropped_at == 1 and got["e"].dropped_at == 1 and got["e"].first_estimate is None
    _, _, resid = lstsq(x, y)
    stay = np.abs(resid) <= 2.0
    beta, _, _ = lstsq(x[stay][:, 1:], y[stay])
    assert [got[v].estimate for v in ("b", "c", "d")] == pytest.approx(beta[1:], abs=1e-8)
    with pytest.raises(ValueError):
        G.input_selection(df, "y", ["a"], [], keep="both")


def test_few_rows_and_empty_tables(frame):
    assert G.ols_fit(frame([], DDL), "y", ["a"]).collect() == []
    assert G.trim_refit_multi(frame([], DDL), "y", ["a"]).collect() == []
    one = G.ols_fit(frame([(1.0, 1.0, 1.0, 1.0, 3.0)], DDL), "y", ["a"]).collect()
    assert [(r.term, r.estimate, r.std_error, r.p_value) for r in one] == [("(intercept)", 3.0, None, None)]
    exact = {r.term: r for r in G.ols_fit(frame([(float(i), 0.0, 0.0, 0.0, 2.0 * i) for i in range(5)], DDL), "y", ["a"]).collect()}
    assert exact["a"].estimate == pytest.approx(2.0) and exact["a"].p_value == pytest.approx(0.0, abs=1e-9)


def test_names_with_quotes(frame):
    df = frame([(float(i), float(i * i % 7), 1.5 * i + i % 3) for i in range(20)], "x double, z double, y double").toDF("it's", "z", "y")
    assert {r.term for r in G.ols_fit(df, "y", ["it's", "z"]).collect()} == {"it's", "z", "(intercept)"}


@pytest.mark.parametrize("k", [1, 2, 3, 6])
def test_rotations_give_eigenvalues_and_vectors(spark, k):
    rnd = np.random.default_rng(k)
    a = rnd.normal(size=(k, k))
    a = a + a.T
    if k > 2:
        a[0, 1] = a[1, 0] = 0.0
    df = spark.createDataFrame([([float(v) for v in a.ravel()],)], "m array<double>")
    r = df.select(F.expr(linalg.eigen("m", k)).alias("e")).first().e
    d, v = np.array(r.a).reshape(k, k), np.array(r.v).reshape(k, k)
    assert np.sort(np.diag(d)) == pytest.approx(np.linalg.eigvalsh(a), abs=1e-10)
    assert v.T @ v == pytest.approx(np.eye(k), abs=1e-12) and v @ np.diag(np.diag(d)) @ v.T == pytest.approx(a, abs=1e-10)


def criterion(x):
    return ((x**4).mean(axis=0) - (x**2).mean(axis=0) ** 2).sum()


def test_simple_structure_is_a_maximum(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(7, 3))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    df = spark.createDataFrame([([float(v) for v in x.ravel()], 3)], "m array<double>, n int")
    r = np.array(df.select(F.expr(linalg.varimax("m", 7, "n")).alias("r")).first().r).reshape(7, 3)
    assert (r**2).sum(axis=1) == pytest.approx(np.ones(7), abs=1e-12)
    assert criterion(r) > criterion(x)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        for angle in (-0.2, -1e-3, 1e-3, 0.2):
            c, s = math.cos(angle), math.sin(angle)
            t = r.copy()
            t[:, [i, j]] = t[:, [i, j]] @ np.array([[c, -s], [s, c]])
            assert criterion(t) <= criterion(r) + 1e-12


def test_components_of_constant_columns_and_cut_offs(frame):
    rnd = np.random.default_rng(2)
    rows = [(float(a), float(b), 5.0) for a, b in rnd.normal(size=(200, 2))]
    out = G.pca_loadings(frame(rows, "a double, b double, k double"), ["a", "b", "k"], keep=1.0).collect()
    assert len(out) == 9 and max(r.cum_share for r in out) == pytest.approx(1.0)
    first = G.pca_loadings(frame(rows, "a double, b double, k double"), ["a", "b", "k"], keep=0.3).collect()
    assert {r.component for r in first} == {1}
    assert all(sum(r.loading for r in out if r.component == c) >= 0 for c in (1, 2, 3))


def test_logistic_fit_of_responses_and_shares(frame):
    rnd = np.random.default_rng(21)
    x = rnd.normal(size=(600, 2)) * [1, 4]
    p = 1 / (1 + np.exp(-(0.3 + 1.2 * x[:, 0] - 0.5 * x[:, 1])))
    y = (rnd.random(600) < p).astype(float)
    df = frame([(float(a), float(b), float(v)) for (a, b), v in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    got = {r.term: r.estimate for r in G.logistic_fit(df, "y", ["a", "b"]).collect()}
    design = np.column_stack([np.ones(600), x])
    mu = 1 / (1 + np.exp(-design @ [got["(intercept)"], got["a"], got["b"]]))
    # at the maximum the gradient vanishes
    assert design.T @ (y - mu) == pytest.approx(np.zeros(3), abs=1e-6)


@pytest.mark.parametrize("rows", [[], [(1.0, 1.0)], [(float(i), float(i > 5)) for i in range(12)], [(2.0, float(i % 2)) for i in range(10)]])
def test_logistic_fit_without_a_maximum(frame, rows):
    fit = G.logistic_fit(frame(rows, "x double, y double"), "y", "x").collect()
    assert [(r.term, r.estimate) for r in fit] == [("(intercept)", None), ("x", None)]


def test_logistic_fit_of_steep_curves_needs_halved_steps(frame):
    pts = [(x / 4, 1 / (1 + math.exp(-(9 * x / 4 - 20)))) for x in range(-40, 41)]
    fit = {r.term: r.estimate for r in G.logistic_fit(frame(pts, "x double, p double"), "p", "x").collect()}
    assert fit == {"(intercept)": pytest.approx(-20, rel=1e-5), "x": pytest.approx(9, rel=1e-5)}
