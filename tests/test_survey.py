import pytest
from pyspark.sql import functions as F

from fieldledger.operators import aggregate as A
from fieldledger.operators import columns as C
from fieldledger.operators import joins as J
from fieldledger.operators import reshape as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns_are_checked(frame):
    with pytest.raises(ValueError, match="absent"):
        C.project(frame([(1,)], "a int"), ["a", "absent"])


def test_scale_and_rename(frame):
    df = C.scale_columns(frame([(10.0, 4.0, 2.0), (1.0, 1.0, 0.0)], "x_kg double, p double, acres double"), "_kg$", "acres", "_acre")
    assert df.columns == ["x_kg_acre", "p", "acres"]
    assert [r.x_kg_acre for r in df.collect()] == [5.0, None]
    assert C.rename_by_pattern(df, [(r"_kg", " (kg)")]).columns[0] == "x (kg)_acre"


def test_drop_where_without_a_match_keeps_everything(frame):
    df = frame([(1, 5.0), (2, None), (3, 76500.0)], "id int, price double")
    assert rows(C.drop_where(df, F.col("price") == 76500)) == [(1, 5.0), (2, None)]
    assert C.drop_where(df, F.col("price") == 99999).count() == 3


def test_fill_block_follows_its_trigger(frame):
    df = frame([(None, 2.0, 3.0), (1.0, None, 3.0)], "a double, b double, c double")
    assert rows(C.fill_block(df, "a", ["a", "b"])) == [(0.0, 0.0, 3.0), (1.0, None, 3.0)]


def test_dummies_of_named_levels(frame):
    df = frame([(1, "Oxen (own)"), (2, "none"), (3, None)], "id int, prep string")
    got = C.dummy_columns(df, {"prep": ["Oxen (own)", "none"]})
    assert got.columns == ["id", "prep_oxen_own", "prep_none"]
    assert rows(got) == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]
    with pytest.raises(ValueError, match="second time"):
        C.dummy_columns(df, {"prep": ["a b", "a-b"]})
    assert rows(C.level_rows(df, "id", ["prep"])) == [(1, "prep", "Oxen (own)", 1), (2, "prep", "none", 1)]


def test_dummies_have_no_bound_on_levels(frame):
    levels = [f"v{i}" for i in range(300)]
    got = C.dummy_columns(frame([(1, "v299")], "id int, x string"), {"x": levels})
    assert len(got.columns) == 301 and got.first()["x_v299"] == 1


def test_threshold_includes_the_bound(frame):
    got = C.threshold_flags(frame([(0.15,), (0.1499,), (None,)], "a double"), ["a"]).collect()
    assert [r.a for r in got] == [1, 0, None]


def test_missing_profile(frame):
    got = C.missing_profile(frame([(1, None), (None, None)], "a int, b string"))
    assert rows(got) == [("a", 1), ("b", 2)]


def test_sum_over_nothing_is_zero_and_mean_is_missing(frame):
    df = frame([("x", None), ("y", 2.0), (None, 3.0)], "k string, v double")
    assert rows(A.group_sum(df, ["k"], ["v"])) == rows(frame([("x", 0.0), ("y", 2.0), (None, 3.0)], "k string, v double"))
    assert rows(A.group_mean(df, ["k"], ["v"], drop_missing=True)) == sorted([("y", 2.0), (None, 3.0)], key=repr)


def test_subtotal_keeps_a_null_item_apart(frame):
    df = frame([("f", "can", 1.0), ("f", "npk", 2.0), ("f", None, 4.0), ("g", "can", None)], "k string, t string, v double")
    got = rows(A.with_subtotal(df, ["k"], "t", ["v"]))
    assert got == sorted(
        [("f", "can", 1.0), ("f", "npk", 2.0), ("f", None, 4.0), ("f", "Total", 7.0), ("g", "can", 0.0), ("g", "Total", 0.0)],
        key=repr,
    )


def test_joins_on_missing_keys(frame):
    a, b = frame([(None, 1), ("x", 2)], "k string, a int"), frame([(None, 3), ("x", 4)], "k string, b int")
    assert rows(J.join_on(a, b, ["k"])) == [("x", 2, 4)]
    assert rows(J.join_on(a, b, ["k"], null_safe=True)) == sorted([("x", 2, 4), (None, 1, 3)], key=repr)


def test_left_join_chain_keeps_first(frame):
    a = frame([(1, "p"), (2, "q")], "id int, d string")
    b, c = frame([(1, 5)], "id int, x int"), frame([("q", 7)], "d string, y int")
    assert rows(J.left_join_chain(a, [b, c]).select("id", "d", "x", "y")) == [(1, "p", 5, None), (2, "q", None, 7)]
    with pytest.raises(ValueError):
        J.natural_join(a, frame([(1,)], "z int"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join_with_a_hot_key(spark, how):
    fact = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") % 50).cast("int")).alias("k"), F.col("id").alias("v")
    )
    dim = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("w"))
    got = J.salted_join(fact, dim, ["k"], how, salts=8)
    assert rows(got.select("k", "v", "w")) == rows(fact.join(dim, ["k"], how).select("k", "v", "w"))
    unhinted = J.dimension_join(fact, dim, ["k"], how, max_rows=5)
    assert rows(unhinted.select("k", "v", "w")) == rows(got.select("k", "v", "w"))


def test_salt_spreads_the_hot_key(spark):
    fact = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    dim = spark.range(3).select(F.col("id").cast("int").alias("k"))
    plan = J.salted_join(fact, dim, ["k"], salts=16)._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    spread = F.pmod(F.xxhash64("k", "v"), F.lit(16))
    largest = fact.groupBy(spread.alias("s")).count().agg(F.max("count")).first()[0]
    assert largest < 400


def test_share_duplicates_cohort(frame):
    df = frame([("a", 1.0), ("a", 3.0), ("b", 0.0)], "k string, v double")
    assert rows(A.share_of_group(df, ["k"], "v", "pct")) == rows(
        frame([("a", 1.0, 25.0), ("a", 3.0, 75.0), ("b", 0.0, None)], "k string, v double, p double")
    )
    assert rows(A.duplicate_rows(df, ["k"])) == [("a", 1.0, 2), ("a", 3.0, 2)]
    assert {r.k for r in A.largest_cohort(df, "k").collect()} == {"a"}
    assert rows(A.single_valued(df, ["k"], "v")) == [("a", 1.0, 3.0)]


def test_pivot_unpivot_identity(frame):
    df = frame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0)], "id int, t string, v double")
    wide = R.pivot_wide(df, ["id"], "t", ["a", "b"], "v")
    assert rows(wide) == [(1, 2.0, 3.0), (2, 4.0, 0.0)]
    back = R.unpivot_long(wide, ["id"], ["a", "b"], "t", "v").filter("v <> 0")
    assert rows(back) == rows(df)


def test_unit_price_of_zero_quantity_is_missing(frame):
    df = frame([(1, "a", 2.0, 6.0), (1, "b", 0.0, 0.0)], "id int, t string, kg double, kes double")
    wide = R.pivot_measures(df, ["id"], "t", ["a", "b"], ["kg", "kes"])
    assert rows(wide) == [(1, 2.0, 6.0, 0.0, 0.0, 2.0, 6.0)]
    assert rows(R.unit_prices(wide, ["id"], ["a", "b"], "kes", "kg")) == [(1, 3.0, None, 3.0)]
    one = R.pivot_measures(df, ["id"], "t", ["a", "b"], ["kg"])
    assert one.columns == ["id", "a_kg", "b_kg", "total_kg"] and rows(one) == [(1, 2.0, 0.0, 2.0)]


def test_nearest_cell_prefers_the_lower_on_a_tie(frame):
    df = frame([("k", 1.0, 10), ("k", 3.0, 30), ("j", 9.0, 90)], "g string, x double, y int")
    assert rows(R.nearest_cell(df, ["g"], "x", 2.0, ["y"])) == [("j", 9.0, 90), ("k", 1.0, 10)]


def test_grid_generation(frame):
    got = rows(J.with_grid(frame([("a",)], "k string"), "p", 0.5, 1.5, 3, index="i"))
    assert got == [("a", 0.5, 0), ("a", 1.0, 1), ("a", 1.5, 2)]


def test_most_frequent_value_is_not_a_missing_one(frame):
    df = frame([(None, 1), (None, 2), (None, 3), ("a", 4), ("a", 5), ("b", 6)], "k string, v int")
    assert sorted(r.v for r in A.largest_cohort(df, "k").collect()) == [4, 5]
