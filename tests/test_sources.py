import datetime as dt

from fieldledger import sources as S


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_round_trip(spark, frame, tmp_path):
    rows = [(1, "a, b", 2.5), (2, None, None)]
    S.write_csv(frame(rows, "id int, name string, x double"), str(tmp_path / "out"))
    back = S.read_csv(spark, str(tmp_path / "out"), "id int, name string, x double")
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_market_prices_drop_title_and_tag_market(spark, tmp_path):
    body = "Price of grain per KG in {0} town\n\nDate,Price\nJanuary-2001,71.5\nMarch-2001,40.089999999999996\n"
    paths = [put(tmp_path / f"Grain price {m} X.csv", body.format(m)) for m in ("North", "South")]
    got = S.read_market_prices(spark, paths, r"price (\w+) X\.csv").orderBy("market", "date").collect()
    assert [tuple(r) for r in got[:2]] == [("North", dt.date(2001, 1, 1), 71.5), ("North", dt.date(2001, 3, 1), 40.09)]
    assert {r.market for r in got} == {"North", "South"} and len(got) == 4


def test_quote_file_blanks_are_null(spark, tmp_path):
    text = 'Date,"A, wholesale","B, wholesale"\r\n2/1/2003,,7\r\n1/1/2003,8,9.125\r\n'
    got = S.read_quote_prices(spark, put(tmp_path / "q.csv", text), ["a", "b"]).orderBy("market", "date").collect()
    assert [tuple(r) for r in got] == [
        (dt.date(2003, 1, 1), "a", 8.0),
        (dt.date(2003, 2, 1), "a", None),
        (dt.date(2003, 1, 1), "b", 9.125),
        (dt.date(2003, 2, 1), "b", 7.0),
    ]


def test_promoted_header(spark, tmp_path):
    text = "Source,Location,City,State\nX,1902020,-,-\nYear,Month,Hour,Temp\n2018,3,7,15.5\n2018,3,8,16\n"
    names = ["Year", "Month", "Hour", "Temp"]
    got = S.read_promoted_header(spark, put(tmp_path / "w.csv", text), names, names, "Year").collect()
    assert sorted(tuple(r) for r in got) == [(2018.0, 3.0, 7.0, 15.5), (2018.0, 3.0, 8.0, 16.0)]


def test_trailing_header(spark, tmp_path):
    text = "dist,yield..kg.acre.,oxen\nNorth,6.5,1\nSouth,,0\ndist,yield (kg/acre),oxen\n"
    names = ["dist", "yield (kg/acre)", "oxen"]
    got = S.read_trailing_header(spark, put(tmp_path / "m.csv", text), names, ["dist"])
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == [("North", 6.5, 1.0), ("South", None, 0.0)]


def test_county_file(spark, tmp_path):
    text = '_id,COUNTY,Year,Area,Production,Yield\n1,North,2001,"1,234","5,678",4.6\n2,South,2001,12,-4,0.3\n'
    got = S.read_county_production(spark, put(tmp_path / "c.csv", text, "utf-8-sig")).orderBy("id").collect()
    assert tuple(got[0]) == (1, "North", 2001, 1234.0, 5678.0, 4.6, 1)
    assert got[1].valid == 0 and got[1].production_mt is None and got[1].area_ha is None


def test_tagged_union(spark, tmp_path):
    for name in ("aa", "bb"):
        spark.range(2).write.parquet(str(tmp_path / name / f"{name}.parquet"))
    parts = [S.tag_source(spark.read.parquet(str(tmp_path / n / f"{n}.parquet"))) for n in ("aa", "bb")]
    got = S.union_sources(parts).groupBy("source").count().collect()
    assert sorted(tuple(r) for r in got) == [("aa", 2), ("bb", 2)]


def test_literal_table(spark):
    assert S.literal_table(spark, [(2006, 2.7), (2007, None)], "yr int, x double").count() == 2
