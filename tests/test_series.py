import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fieldledger.operators import series as S


def monthly(frame, values):
    """Series of market ``m``: {(year, month): price}."""
    return frame([("m", dt.date(y, m, 1), p) for (y, m), p in values.items()], "market string, date date, price double")


def test_two_meanings_of_log_change(frame):
    df = monthly(frame, {(2006, 1): 10.0, (2006, 2): 20.0, (2006, 5): 40.0})
    by_row = {r.date.month: r.log_change for r in S.log_change(df, "market").collect()}
    assert by_row == {1: None, 2: pytest.approx(math.log(2)), 5: pytest.approx(math.log(2))}
    dense = S.log_change_calendar(df, "market", "month").collect()
    assert {r.date.month: r.log_change for r in dense} == {1: None, 2: pytest.approx(math.log(2)), 3: None, 4: None, 5: None}


def test_zero_price_has_no_log_change(frame):
    df = monthly(frame, {(2006, 1): 10.0, (2006, 2): 0.0, (2006, 3): 5.0})
    assert [r.log_change for r in S.log_change(df, "market").orderBy("date").collect()] == [None, None, None]


def test_densify_keeps_every_row_and_each_entity_range(frame):
    rows = [("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 4), 2.0), ("b", dt.date(2024, 1, 9), 3.0)]
    df = frame(rows, "market string, date date, price double")
    dense = S.densify(df, "market")
    assert dense.filter("price is not null").count() == 3 and dense.count() == 5


def test_weekends_removed_after_densify(frame):
    rows = [("a", dt.date(2024, 1, 5), 1.0), ("a", dt.date(2024, 1, 8), 2.0)]  # Friday, Monday
    out = S.log_change_calendar(frame(rows, "market string, date date, price double"), "market", weekdays_only=True)
    assert [r.log_change for r in out.orderBy("date").collect()] == [None, pytest.approx(math.log(2))]


def test_season_windows_and_expected_price(frame):
    prices = {(y, m): 10.0 * math.exp(0.1 * ((y - 2006) * 12 + m)) for y in (2006, 2007) for m in range(1, 13)}
    df = monthly(frame, prices)
    drift = {r.season: (r.m, r.n) for r in S.season_drift(df, "market", 3, 12).collect()}
    assert drift[2006] == (pytest.approx(0.1), 12) and drift[2005][1] == 1
    out = {r.season: r for r in S.expected_price_anomaly(df, "market", 3, 12, 5).collect()}
    assert out[2007].expected == pytest.approx(prices[2007, 8]) and out[2007].anomaly_pct == pytest.approx(0.0, abs=1e-9)
    assert out[2005].expected is None


def test_overlapping_window_is_differenced_within(frame):
    df = monthly(frame, {(2006 + (m - 1) // 12, (m - 1) % 12 + 1): math.exp(0.2 * m) for m in range(1, 25)})
    got = {r.season: r.n for r in S.season_drift(df, "market", 7, 14, within=True).collect()}
    assert got[2006] == 13
    rows = S.season_windows(df, "market", 7, 14).filter(F.col("date") == dt.date(2007, 8, 1)).collect()
    assert sorted((r.season, r.step) for r in rows) == [(2006, 13), (2007, 1)]


def test_missing_season_breaks_the_lag(frame):
    df = monthly(frame, {(2006, 3): 1.0, (2006, 4): 2.0, (2008, 3): 3.0, (2008, 4): 4.0})
    out = {r.season: r.m_prev for r in S.expected_price_anomaly(df, "market", 3, 12, 1).collect()}
    assert out == {2006: None, 2008: None}


def test_anchor_and_fallback(frame):
    rows = [("a", 2006, 3, 5.0), ("a", 2006, 2, 9.0), ("b", 2006, 2, 4.0), ("b", 2006, 4, 6.0), ("c", 2006, 7, 1.0)]
    df = frame(rows, "market string, year int, month int, price double")
    got = S.price_at_anchor(df, ["market", "year"], F.col("month"), "price", 3, (2, 4)).collect()
    assert sorted(tuple(r) for r in got) == [("a", 2006, 5.0, 1), ("b", 2006, 5.0, 0)]


def test_regimes_apply_to_every_anchor(frame):
    changes = frame([("up", 0.1), ("up", 0.3), ("down", -0.1), ("down", None)], "regime string, log_change double")
    anchors = frame([("up", 10.0), ("down", 10.0)], "regime string, p0 double")
    out = S.expected_by_regime(anchors, S.drift_by_regime(changes), 2)
    got = {r.regime: r.expected for r in out.collect()}
    assert got == {"up": pytest.approx(10 * math.exp(0.4)), "down": pytest.approx(10 * math.exp(-0.2))}


def test_forecast_anomaly(frame):
    e = frame([("a", 12.0), ("b", 1.0)], "market string, expected double")
    p = frame([("a", 10.0), ("b", 0.0)], "market string, pt double")
    got = {r.market: r.anomaly_pct for r in S.forecast_anomaly(e, p, ["market"]).collect()}
    assert got == {"a": pytest.approx(20.0), "b": None}


def test_weather_means_over_daylight(frame):
    rows = [(2018, 3, d, h, t) for d, base in ((1, 10.0), (2, 20.0)) for h, t in ((6, 99.0), (7, base), (18, base + 2))]
    df = frame(rows, "year int, month int, day int, hour int, temp double")
    out = S.weather_daily(df, (7, 18), (3, 7), ["temp"]).orderBy("date").collect()
    assert [r.value for r in out] == [11.0, 21.0]
    assert out[1].log_change == pytest.approx(math.log(21 / 11))


def test_weeks_of_two_years_are_kept_apart(spark, tmp_path):
    import datetime as dt

    from fieldledger.plans import prices

    days = [dt.datetime(y, 1, 5) + dt.timedelta(days=i) for y in (2021, 2022) for i in range(21)]
    rows = [(i, t, "view", 1, float(10 + i % 5 + 90 * (t.year - 2021))) for i, t in enumerate(days)]
    columns = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    made = spark.createDataFrame(rows, "i int, ts timestamp, kind string, k int, value double")
    filled = made.select(*[F.col(c.name).cast(c.dataType) if c.name in ("ts", "value") else F.lit("1").cast(c.dataType).alias(c.name) for c in columns])
    filled.write.parquet(f"{tmp_path}/events.parquet")
    _, expected = prices.weekly_expected(spark, str(tmp_path))
    weeks = {r.wk for r in expected.select("wk").collect()}
    assert {w // 100 for w in weeks} == {2021, 2022}
    assert {r.wk // 100 for r in expected.filter("p0 > 80").collect()} == {2022}
