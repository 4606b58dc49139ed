"""The survey pipeline on hand-made tables with the awkward rows of a real survey."""

import math

import pytest

from fieldledger.plans import farm_etl as E

HYB = "purchased new hybrid"


@pytest.fixture
def survey(frame):
    crop = frame(
        [
            ("North", "h1", 1, "maize-dry", "main", HYB, 100.0, 10.0, 500.0),
            ("North", "h1", 1, "maize-green", "main", "retained", 200.0, None, None),
            ("North", "h1", 2, "maize-dry", "main", "retained", None, 5.0, 100.0),
            ("North", "h1", 1, "beans", "main", "retained", 30.0, 2.0, 50.0),
            ("North", "h1", 1, "maize-dry", "short", HYB, 999.0, 1.0, 1.0),
            ("South", "h2", 1, "maize-dry", "main", None, 50.0, 4.0, 80.0),
            ("South", "h2", 1, "wheat", "main", None, 70.0, 4.0, 80.0),
        ],
        "dist string, hhid string, field int, crop string, harvest string, sdtype string, kgharv double, seedkg double, scost double",
    )
    field = frame(
        [
            ("h1", 1, "main", "owned with title deed", "rain", "oxen", 2.0, 100.0),
            ("h1", 2, "main", "rented", "irrigated (piped)", "tractor", 3.0, 200.0),
            ("h2", 1, "main", "rented", "rain", "manual", 1.0, 0.0),
        ],
        "hhid string, field int, harvest string, tenure string, watersrc string, landprep string, acres double, lpcost double",
    )
    fert = frame(
        [
            ("h1", 1, "main", "CAN (26:0:0)", 20.0, 800.0),
            ("h1", 1, "main", "CAN (26:0:0)", 10.0, 400.0),
            ("h1", 1, "main", "dap", 5.0, 300.0),
            ("h1", 1, "main", "NPK+CAN", 77.0, 77.0),
            ("h1", 2, "main", "manure", 100.0, None),
            ("h2", 1, "main", "dap", 0.0, 0.0),
        ],
        "hhid string, field int, harvest string, ferttype string, fertotal double, fertcost double",
    )
    inputs = frame(
        [
            ("h1", "maize-dry", "Pesticide", 500.0, 2.0, "gram"),
            ("h1", "maize-green", "Herbicide", 1.0, 180.0, "90 kg bag"),
            ("h1", "maize-dry", "Pesticide", 1.0, 76500.0, "kg"),
            ("h1", "maize-dry", "Seed", 7.0, 11.0, "kg"),
        ],
        "hhid string, mcrop string, inputype string, numpur double, inputpr double, punit string",
    )
    labour = frame(
        [
            ("h1", "planting", 2.0, 3.0, 80.0, 1.0, 10.0, 2.0, 5.0, None, None),
            ("h1", "weeding", None, None, None, 1.0, 4.0, 0.0, 0.0, 1.0, 2.0),
        ],
        "hhid string, activity string, lb01 double, lb02 double, lb03 double, lb05 double, lb06 double, lb07 double, lb08 double, lb09 double, lb10 double",
    )
    rain = frame([("h1", 600.0, 500.0), ("h2", None, 500.0)], "hhid string, main07 double, qwetpre double")
    price = frame(
        [("North", "maize", 14.0), ("North", "beans", 40.0), ("South", "maize", 12.0)],
        "dist string, crop string, price_kes_kg double",
    )
    return crop, field, fert, inputs, labour, rain, price, ["planting", "weeding"]


def test_farm_table(survey):
    got = {(r.hhid, r.crop): r for r in E.farm_table(*survey).collect()}
    assert set(got) == {("h1", "maize"), ("h1", "beans"), ("h2", "maize")}
    m = got["h1", "maize"]
    # two fields: 100 + 0.85 * 200 on one, nothing reported on the other, over five acres
    assert m.acres == 5.0 and m.yield_kg_acre == pytest.approx(270 / 5)
    assert (m.adopter, m.oxen, m.tractor, m.irrigated, m.tenure_deed) == (1, 1, 1, 1, 1)
    assert m.can_kg_acre == pytest.approx(6.0) and m.synth_kg_acre == pytest.approx(7.0)
    assert m.synth_kes_acre == pytest.approx(300.0) and m.manure_kg_acre == pytest.approx(20.0)
    # half a kilogram at 2000 a kilogram, and a 90 kg bag at 2 a kilogram; the bad price is gone
    assert m.chem_kg_acre == pytest.approx(90.5 / 5) and m.chem_kes_acre == pytest.approx((1000 + 180) / 5)
    assert m.pesticide_kg_acre == pytest.approx(0.1) and m.herbicide_kes_acre == pytest.approx(36.0) and m.fungicide_kg_acre == 0
    assert m.planting_wage_hours_acre == pytest.approx(48 / 5) and m.planting_wage_kes_acre == pytest.approx(480 / 5)
    assert m.planting_family_hours_acre == pytest.approx(20 / 5) and m.total_family_hours_acre == pytest.approx(26 / 5)
    assert (m.planting_male_hours_acre, m.planting_female_hours_acre) == (pytest.approx(2.0), pytest.approx(2.0))
    assert m.total_adult_hours_acre == pytest.approx(24 / 5) and m.weeding_child_hours_acre == pytest.approx(2 / 5)
    assert m.cost_acre == pytest.approx(300 + 600 / 5 + 300 + 236) and m.acres_pct == pytest.approx(1.0)
    assert m.rain_anomaly == pytest.approx(1.2) and m.revenue_acre == pytest.approx(14 * 54)
    # a household without a chemical purchase counts as using none
    assert got["h1", "beans"].chem_kes_acre == 0.0 and got["h2", "maize"].chem_kg_acre == 0.0
    assert got["h2", "maize"].rain_anomaly is None


def test_bad_price_rule_without_a_hit(survey):
    inputs = survey[3].filter("inputpr < 1000")
    kept = E.chemicals_wide(inputs).first()
    assert kept.chem_kg == pytest.approx(90.5) and E.chemicals_wide(inputs, None).first().chem_kg == kept.chem_kg


def test_log_table(survey):
    farms = E.farm_table(*survey)
    got = E.log_table(farms, "maize", ["yield_kg_acre", "npk_kg_acre", "rain_anomaly"], ["adopter", "oxen"]).collect()
    assert len(got) == 1
    assert tuple(got[0]) == ("North", pytest.approx(math.log(54)), 0.0, pytest.approx(math.log(1.2)), 1, 1)
    with pytest.raises(ValueError, match="dap_price"):
        E.log_table(farms, "maize", ["dap_price"], [])


INPUTS = "dist string, hhid string, mcrop string, inputype string, numpur double, inputpr double, punit string"


def test_chemicals_of_dry_and_green_maize_are_maize(frame):
    rows = [
        ("d", "h", "maize-dry", "Fungicide", 2.0, 10.0, "kgs"),
        ("d", "h", "maize-green", "Fungicide", 1.0, 10.0, "kgs"),
        ("d", "h", "tea", "Fungicide", 9.0, 1.0, "kgs"),
        ("d", "h", "maize-dry", "Fertilizer", 9.0, 1.0, "kgs"),
        ("d", "h", "maize-dry", None, 9.0, 1.0, "kgs"),
    ]
    got = E.chemicals_wide(frame(rows, INPUTS)).collect()
    assert [(r.crop, r.fungicide_kg, r.chem_kg, r.chem_kes) for r in got] == [("maize", 3.0, 3.0, 30.0)]


def test_district_prices_are_lognormal_means(frame):
    rows = [
        ("d", "h1", "beans", "Herbicide", 1.0, 10.0, "kg"),
        ("d", "h1", "beans", "Herbicide", 3.0, 30.0, "kg"),
        ("d", "h2", "beans", "Herbicide", 1.0, 5.0, "kg"),
        ("d", "h3", "beans", "Herbicide", 1.0, 0.0, "kg"),
        ("d", "h2", "beans", "Pesticide", 1.0, 7.0, "kg"),
        ("e", "h4", "beans", "Pesticide", None, 7.0, "kg"),
    ]
    got = {r.dist: r for r in E.chemical_prices(frame(rows, INPUTS)).collect()}
    a, b = math.log(20.0), math.log(5.0)
    assert got["d"].herbicide_price == pytest.approx(math.exp((a + b) / 2 + (a - b) ** 2 / 4))
    a, b = math.log(25.0), math.log(6.0)
    assert got["d"].chem_price == pytest.approx(math.exp((a + b) / 2 + (a - b) ** 2 / 4))
    # one household alone has no deviation
    assert got["d"].pesticide_price is None and got["e"].pesticide_price is None and got["e"].chem_price is None
    assert E.chemical_prices(frame([], INPUTS)).collect() == []


def test_heads_need_a_size_and_are_one_row(frame):
    members = frame(
        [("h1", "head", 40.0, "male"), ("h1", "spouse", 30.0, "female"), ("h2", "head", 50.0, "female"), ("h3", "head", 60.0, "male"), (None, "head", 1.0, "male"), ("h4", "head", None, None), ("h2", "head", 60.0, "male")],
        "hhid string, da03 string, age double, gend string",
    )
    sizes = frame([("h1", 4), ("h2", 2), ("h4", None), ("h9", 1)], "hhid string, hhsize int")
    got = {r.hhid: tuple(r)[1:] for r in E.household_heads(members, sizes).collect()}
    assert got == {"h1": (40.0, 0, 4), "h2": (55.0, 1, 2), "h4": (None, None, None)}


def test_rain_meets_the_climate_of_its_division(frame):
    rain = frame(
        [("h1", "rift valley", "uasin gishu", "soy", 500.0), ("h2", "rift valley", "uasin gishu", "turbo", 400.0), ("h3", None, "uasin gishu", "soy", 1.0)],
        "hhid string, prov string, dist string, div string, main07 double",
    )
    climate = frame(
        [("Rift Valley", "Uasin Gishu", "Soy", v, x, 1.0, 2.0) for v, x in (("a", 100.0), ("b", 300.0), ("c", None))],
        "prov string, dist string, div string, vil string, qwetpre double, qwetit double, qwetxt double",
    )
    assert [tuple(r) for r in E.household_rain(rain, climate).collect()] == [("h1", 500.0, 200.0, 1.0, 2.0)]


def test_title_case_leaves_the_rest_of_a_word(frame):
    from fieldledger.functions import title_case

    rows = frame([("trans nzoia",), ("McKay o'neil",), ("",), (None,), ("\u00e9tat  x",)], "t string")
    assert [r.u for r in rows.select(title_case("t").alias("u")).collect()] == ["Trans Nzoia", "McKay O'neil", "", None, "\u00c9tat  X"]


def test_model_table_keeps_households_without_a_table(frame, survey):
    crop, field, fert, inputs, labour, _, price, acts = survey
    rain = frame([("h1", "p", "d", "v", 600.0)], "hhid string, prov string, dist string, div string, main07 double")
    climate = frame([("P", "D", "V", "x", 500.0, 1.0, 2.0)], "prov string, dist string, div string, vil string, qwetpre double, qwetit double, qwetxt double")
    members = frame([("h2", "head", 44.0, "female")], "hhid string, da03 string, age double, gend string")
    sizes = frame([("h2", 3)], "hhid string, hhsize int")
    from pyspark.sql import functions as F

    bought = inputs.withColumn("dist", F.lit("North"))
    got = {
        (r.hhid, r.crop): r
        for r in E.model_table(crop, field, fert, bought, labour, members, sizes, rain, climate, price, acts, ["weeding"]).collect()
    }
    assert set(got) == {("h1", "maize"), ("h1", "beans"), ("h2", "maize")}
    assert got["h1", "maize"].rain_anomaly == pytest.approx(1.2) and got["h1", "maize"].hhsize is None
    assert (got["h2", "maize"].head_age, got["h2", "maize"].head_female, got["h2", "maize"].hhsize) == (44.0, 1, 3)
    assert got["h2", "maize"].rain_anomaly is None and got["h2", "maize"].later_wage_hours_acre is None
    assert got["h1", "maize"].later_wage_hours_acre == 0.0


def test_adoption_is_the_share_of_entries(frame):
    schema = "dist string, hhid string, field int, crop string, harvest string, sdtype string, kgharv double, seedkg double, scost double"
    rows = [("d", "h", 1, "maize-dry", "main", "purchased new hybrid" if i == 0 else "retained", 1.0, 1.0, 1.0) for i in range(10)]
    assert E.crop_by_field(frame(rows, schema)).first().adopter == pytest.approx(0.1)
