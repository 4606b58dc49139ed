"""Files whose header must be found: ranges of bytes, titles, trailers, marks, errors."""

import pytest

from fieldledger.sources.framed import FramedReader, data_bounds, read_framed, write_lines

HEADER = ["Date", "Price"]


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return sorted((tuple(r)[:-1] for r in df.collect()), key=repr)


@pytest.mark.parametrize("step", [1, 2, 7, 64, 1 << 20])
def test_ranges_cut_anywhere_give_every_line_once(spark, tmp_path, step):
    body = "".join(f"d{i},{i * i}\r\n" if i % 3 else f'"x, {i}",é{i}\n' for i in range(30)) + "last,1"
    path = put(tmp_path / "a.csv", "A title, of two\n1,2\n\nDate,Price\n" + body)
    want = sorted((f"d{i}", str(i * i)) if i % 3 else (f"x, {i}", f"é{i}") for i in range(30)) + [("last", "1")]
    df = read_framed(spark, [path], HEADER, range_bytes=step) if step > 5 else None
    if df is not None:
        assert rows(df) == sorted(want, key=repr)
    # the same without an engine, at every step
    options = {"paths": f'["{path}"]', "header": '["Date", "Price"]', "trailer": "null", "names": '["d", "p"]', "range": str(step)}
    reader = FramedReader(options)
    got = [(d, p) for part in reader.partitions() for b in reader.read(part) for d, p in zip(*(c.to_pylist() for c in b.columns[:2]))]
    assert sorted(got) == sorted(want)


def test_trailer_mark_short_and_blank_lines(spark, tmp_path):
    path = put(tmp_path / "b.csv", "Date,Price\na,1\n\nb\n,,\nc,3,surplus\nDay,Cost\n\n", "utf-8-sig")
    got = rows(read_framed(spark, [path], HEADER, ["d", "p"], trailer=["Day", "Cost"]))
    assert sorted(map(repr, got)) == sorted(map(repr, [("a", "1"), ("b", None), (None, None), ("c", "3")]))
    # a last line that is no trailer stays
    assert len(rows(read_framed(spark, [path], HEADER, trailer=["Other", "Names"]))) == 5


def test_files_keep_their_names_and_need_a_header(spark, tmp_path):
    paths = [put(tmp_path / f"{n}.csv", f"title of {n}\nDate,Price\n{n},1\n") for n in ("north", "south")]
    got = {(r.Date, r.file) for r in read_framed(spark, paths, HEADER).collect()}
    assert got == {("north", paths[0]), ("south", paths[1])}
    empty = put(tmp_path / "empty.csv", "Date,Price\n")
    assert read_framed(spark, [empty], HEADER).collect() == [] == read_framed(spark, [], HEADER).collect()
    with pytest.raises(Exception, match="no line with the fields"):
        read_framed(spark, [put(tmp_path / "none.csv", "a,b\n1,2\n")], HEADER).collect()


def test_bounds_of_header_and_trailer(tmp_path):
    path = put(tmp_path / "c.csv", "t\nDate,Price\n1,2\nDate,Price\n")
    assert data_bounds(path, HEADER, None) == (13, 28) and data_bounds(path, HEADER, HEADER) == (13, 17)
    only = put(tmp_path / "d.csv", "Date,Price\nDate,Price")
    assert data_bounds(only, HEADER, HEADER) == (11, 11)


def test_lines_are_written_in_order(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"l{i}", "ab"[i % 2]) for i in range(9, -1, -1)], "n int, line string, f string").repartition(4)
    (one,) = write_lines(lines, str(tmp_path / "one"), ["n"])
    assert open(one.removeprefix("file:").replace("//", "/")).read().split() == [f"l{i}" for i in range(10)]
    assert len(write_lines(lines, str(tmp_path / "two"), ["n"], file="f")) == 2
