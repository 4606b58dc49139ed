"""Work that the farm queries must do once only, whatever the number of tables joined."""

import re

import pytest

from fieldledger.operators import joins as J
from fieldledger.operators import reshape as R
from fieldledger.plans import farm_etl as E


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_chain_computes_its_first_table_once(spark, no_broadcast):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    first = spark.range(60).selectExpr("id % 20 AS k", "id AS v").mapInArrow(counted, "k long, v long")
    others = [spark.range(10 + i).selectExpr("id AS k", f"id * {i + 2} AS w{i}").distinct() for i in range(3)]
    got = J.left_join_chain(first, others).collect()
    want = [(v % 20, v, *[v % 20 * (i + 2) if v % 20 < 10 + i else None for i in range(3)]) for v in range(60)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert seen.value == 60


def shuffles(df) -> int:
    return len(re.findall(r"\bExchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_a_pivot_of_measures_shuffles_once(frame):
    rows = [(1, "a", 2.0, 6), (1, None, 5.0, 1), (1, "z", 5.0, 1), (None, "b", None, 3), (None, "b", 4.0, None), (2, "z", 1.0, 1)]
    wide = R.pivot_measures(frame(rows, "id int, t string, kg double, n int"), ["id"], "t", ["a", "b"], ["kg", "n"])
    assert shuffles(wide) == 1
    assert wide.columns == ["id", "a_kg", "a_n", "b_kg", "b_n", "total_kg", "total_n"]
    want = [(1, 2.0, 6.0, 0.0, 0.0, 2.0, 6.0), (None, 0.0, 0.0, 4.0, 3.0, 4.0, 3.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    assert sorted(map(tuple, wide.collect()), key=repr) == sorted(want, key=repr)


def test_district_prices_shuffle_households_once(frame):
    schema = "dist string, hhid string, mcrop string, inputype string, numpur double, inputpr double, punit string"
    rows = [(None, None, "beans", "Herbicide", 1.0, p, "kg") for p in (10.0, 30.0)] + [(None, "h", "beans", "Herbicide", 1.0, 20.0, "kg")]
    prices = E.chemical_prices(frame(rows, schema))
    assert shuffles(prices) == 2
    # both households pay 20 a kilogram, so nothing is added for the spread
    assert [(r.dist, r.crop, round(r.herbicide_price, 9), r.fungicide_price) for r in prices.collect()] == [(None, "beans", 20.0, None)]
