"""Stata files: row ranges, byte orders, missing values, value labels, chosen columns, errors."""

import numpy as np
import pandas as pd
import pytest

from fieldledger.sources.stata import read_layout, read_stata

ROWS = pd.DataFrame(
    {
        "hhid": np.arange(50, dtype=np.int32) * 100003,
        "small": pd.Series(np.arange(50) % 7, dtype=np.int8),
        "mid": pd.Series(np.arange(50) * 300, dtype=np.int16),
        "kg": [None if i % 5 == 0 else i / 8 for i in range(50)],
        "part": pd.Series([None if i % 9 == 0 else i / 4 for i in range(50)], dtype=np.float32),
        "name": ["" if i % 4 == 0 else f"née {i}" for i in range(50)],
        "kind": pd.Categorical([None if i % 6 == 0 else ["maize, dry", "beans"][i % 2] for i in range(50)]),
    }
)


def plain(frame, columns):
    out = []
    for row in frame[columns].itertuples(index=False):
        out.append(tuple(None if pd.isna(v) or v == "" else v.item() if isinstance(v, np.generic) else v for v in row))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("step", [1, 200, 1 << 20])
def test_ranges_of_rows_give_every_row_once(spark, tmp_path, order, step):
    path = str(tmp_path / "a.dta")
    ROWS.to_stata(path, write_index=False, version=114, byteorder=order)
    df = read_stata(spark, [path], range_bytes=step)
    assert dict(df.dtypes) == {"hhid": "int", "small": "int", "mid": "int", "kg": "double", "part": "double", "name": "string", "kind": "string"}
    assert got(df) == plain(ROWS, list(ROWS.columns))


def test_chosen_columns_of_several_files(spark, tmp_path):
    paths = [str(tmp_path / f"{i}.dta") for i in range(3)]
    # the same labels have other codes in each file
    parts = [ROWS[:20], ROWS[20:].assign(kind=ROWS["kind"][20:].cat.set_categories(["x", "beans", "maize, dry"]))]
    for path, part in zip(paths[:2], parts, strict=True):
        part.to_stata(path, write_index=False, version=114, data_label="a survey", variable_labels={"kg": "kilograms"})
    # the third has the same columns and labels, but no rows
    raw = open(paths[0], "rb").read()
    with open(paths[0], "rb") as file:
        layout = read_layout(file, "latin-1")
    with open(paths[2], "wb") as file:
        file.write(raw[:6] + bytes(4) + raw[10 : layout.start] + raw[layout.start + layout.width * layout.rows :])
    assert got(read_stata(spark, [paths[2]])) == []
    assert got(read_stata(spark, paths, ["kind", "hhid"])) == plain(ROWS, ["kind", "hhid"])


def test_numbers_without_a_label_are_their_own_text(spark, tmp_path):
    path = str(tmp_path / "a.dta")
    frame = pd.DataFrame({"unit": np.array([1, 2, 9], np.int16), "x": [1.5, 2.5, 3.5]})
    frame.to_stata(path, write_index=False, version=114, value_labels={"unit": {1: "gram", 2: "kg"}})
    assert got(read_stata(spark, [path])) == [("9", 3.5), ("gram", 1.5), ("kg", 2.5)]


def test_errors_name_what_is_wrong(spark, tmp_path):
    path, other = str(tmp_path / "a.dta"), str(tmp_path / "b.dta")
    ROWS.to_stata(path, write_index=False, version=114)
    ROWS.assign(hhid=ROWS["hhid"] / 2).to_stata(other, write_index=False, version=114)
    with pytest.raises(ValueError, match="absent"):
        read_stata(spark, [path], ["absent"])
    with pytest.raises(Exception, match="not \\['int'\\]"):
        read_stata(spark, [path, other], ["hhid"]).collect()
    with pytest.raises(ValueError, match="no file"):
        read_stata(spark, [])
    new = str(tmp_path / "c.dta")
    ROWS.to_stata(new, write_index=False, version=118)
    with pytest.raises(ValueError, match="not a Stata file"):
        read_stata(spark, [new])
    cut = tmp_path / "d.dta"
    raw = open(path, "rb").read()
    with open(path, "rb") as file:
        start = read_layout(file, "latin-1").start
    cut.write_bytes(raw[: start + 10])
    with pytest.raises(Exception, match="ends within its rows"):
        read_stata(spark, [str(cut)], ["hhid"]).collect()
