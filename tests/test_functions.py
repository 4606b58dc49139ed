import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fieldledger import functions as L


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_norm_cdf_against_erfc(frame):
    zs = [x / 7 for x in range(-84, 85)] + [0.0, 7.0710678, 7.08, 38.0, -38.0]
    rows = frame([(z,) for z in zs], "z double").select("z", L.norm_cdf("z").alias("p"), L.norm_pdf("z").alias("f")).collect()
    for r in rows:
        exact = 0.5 * math.erfc(-r.z / math.sqrt(2))
        assert r.p == pytest.approx(exact, abs=2e-15)
        assert r.f == pytest.approx(math.exp(-r.z * r.z / 2) / math.sqrt(2 * math.pi), abs=1e-15)


def test_lognormal_functions(frame):
    df = frame([(2.0, 0.3, 0.8), (-1.0, 0.3, 0.8)], "x double, m double, s double")
    a, b = df.select(L.lognormal_cdf("x", "m", "s").alias("p"), L.lognormal_pdf("x", "m", "s").alias("d")).collect()
    z = (math.log(2) - 0.3) / 0.8
    assert a.p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)))
    assert a.d == pytest.approx(math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / 1.6)
    assert (b.p, b.d) == (0.0, 0.0)


def test_null_policy(frame):
    df = frame([(0.0,), (-2.0,), (None,), (math.e,)], "x double")
    got = df.select(L.safe_log("x"), L.log_positive("x"), L.nz("x"), L.ratio(F.lit(1.0), "x")).collect()
    assert [r[0] for r in got] == [0.0, None, None, pytest.approx(1.0)]
    assert [r[1] for r in got] == [None, None, None, pytest.approx(1.0)]
    assert got[2][2] == 0.0 and got[0][3] is None


def test_rounding_has_no_negative_zero(spark):
    x = one(spark, L.rounded(F.lit(-1e-9), 6))[0]
    assert x == 0.0 and math.copysign(1, x) == 1.0


def test_units(frame):
    df = frame([("gram",), ("gorogoro",), ("90 kg bag",), ("litre",), ("kg",), ("tin",), (None,)], "u string")
    assert [r[0] for r in df.select(L.unit_factor("u")).collect()] == [0.001, 2.0, 90.0, 1.0, 1.0, 1.0, 1.0]


def test_substring_rules_apply_in_order(frame):
    df = frame([("maize-dry",), ("maize-green",), ("beans",), (None,)], "c string")
    got = df.select(L.substring_recode("c", [("maize", "maize"), ("bean", "pulse")])).collect()
    assert [r[0] for r in got] == ["maize", "maize", "pulse", None]


def test_label_skips_absent_parts(frame):
    df = frame([(1, 0, 1), (0, 0, 0), (None, 1, 0)], "h int, t int, o int")
    got = df.select(L.endowment_label({"h": "Hybrid", "t": "Tenure", "o": "Oxen"})).collect()
    assert [r[0] for r in got] == ["Base + Hybrid + Oxen", "Base", "Base + Tenure"]


def test_masked_dot_and_row_sum(frame):
    df = frame([(0.0, 5.0, None), (1.0, 0.0, 2.0)], "a double, b double, c double")
    coefs = {"a": 0.1, "b": 0.2, "c": 0.4}
    got = df.select(L.masked_dot(coefs), L.row_sum(["a", "b", "c"])).collect()
    assert [tuple(r) for r in got] == [(0.2, 5.0), (pytest.approx(0.5), 3.0)]


def test_dates(spark):
    r = one(
        spark,
        L.parse_month_year(F.lit("January-2006")),
        L.parse_month_year(F.lit("Date")),
        L.parse_day(F.lit("7/1/2005"), "M/d/yyyy"),
        L.season_year(F.lit("2007-02-28").cast("date"), 3),
        L.season_year(F.lit("2007-03-01").cast("date"), 3),
    )
    assert tuple(r) == (dt.date(2006, 1, 1), None, dt.date(2005, 7, 1), 2006, 2007)


def test_shares_sum_to_one(frame):
    df = frame([(1.0, 3.0), (0.0, 0.0)], "a double, b double").select(*L.share_of(["a", "b"]).values())
    a, b = df.collect()
    assert sum(a) == pytest.approx(1.0) and tuple(b) == (None, None)
