"""The sink that commits: attempts that failed or were not accepted leave nothing, and readers see whole writes only."""

import json
import os
import subprocess
import sys

import pyarrow as pa
import pytest

from fieldledger.sources.committed import CommittedWriter, Written, committed_files, write_committed
from fieldledger.sources.framed import read_framed

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["a", "b"])


def writer(folder, job="j", trailer="true"):
    return CommittedWriter({"path": str(folder), "header": json.dumps(["a", "b"]), "trailer": trailer}, job)


def test_only_accepted_attempts_stay(tmp_path):
    w = writer(tmp_path)

    def breaks():
        yield batch(("1", "x"))
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        w.write(breaks())
    twice = [w.write(iter([batch(("1", "x"), ("2", None))])) for _ in range(2)]
    nothing = w.write(iter([]))
    assert nothing == Written(None, 0) and committed_files(str(tmp_path)) == []
    w.commit([twice[1], nothing, None])
    (path,) = committed_files(str(tmp_path))
    assert path.endswith(twice[1].name) and open(path).read() == "a,b\n1,x\n2,\na,b\n"
    assert sorted(os.listdir(tmp_path)) == sorted([twice[1].name, "_manifest-j.json"])


def test_abort_leaves_the_folder_as_it_was(tmp_path):
    first = writer(tmp_path, "one", "false")
    first.commit([first.write(iter([batch(("1", "x"))]))])
    second = writer(tmp_path, "two")
    second.abort([second.write(iter([batch(("2", "y"))]))])
    assert [open(p).read() for p in committed_files(str(tmp_path))] == ["a,b\n1,x\n"] and len(os.listdir(tmp_path)) == 2
    # what a commit cut short has moved is not read
    (tmp_path / "part-000009-stray.csv").write_text("a,b\n9,z\n")
    assert len(committed_files(str(tmp_path))) == 1


def test_round_trip_adds_and_refuses(spark, frame, tmp_path):
    folder = str(tmp_path / "t")
    rows = [(i, f'q"{i}, x' if i % 2 else None, i / 8) for i in range(50)] + [(50, "", None), (50, "", None)]
    df = frame(rows, "k int, `the name` string, v double").repartition(3)
    assert committed_files(folder) == [] == write_committed(df.limit(0), folder)
    files = write_committed(df, folder, ["k", "name", "v"], trailer=True)
    assert 1 <= len(files) <= 3

    def read(paths):
        got = read_framed(spark, paths, ["k", "name", "v"], trailer=["k", "name", "v"]).selectExpr("int(k)", "name", "double(v)")
        return sorted((tuple(r) for r in got.collect()), key=repr)

    want = [(k, n or None, v) for k, n, v in rows]
    assert read(files) == sorted(want, key=repr)
    assert read(write_committed(df, folder, ["k", "name", "v"], trailer=True)) == sorted(want * 2, key=repr)
    with pytest.raises(Exception, match="line break"):
        write_committed(frame([("a\nb",)], "t string"), str(tmp_path / "bad"))
    assert committed_files(str(tmp_path / "bad")) == []
    with pytest.raises(ValueError, match="2 names"):
        write_committed(df, folder, ["a", "b"])
    with pytest.raises(Exception, match="only added"):
        df.selectExpr("string(k)").write.format("committed").mode("overwrite").options(header='["k"]', trailer="false").save(folder)


RETRY = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark import TaskContext
from pyspark.sql import SparkSession
from fieldledger.sources.committed import write_committed

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.log.level", "OFF").getOrCreate()

def fails_once(batches):
    for b in batches:
        yield b
    if TaskContext.get().partitionId() == 1 and TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")

df = spark.range(0, 40, 1, 4).mapInArrow(fails_once, "id long")
print("FILES", len(write_committed(df, sys.argv[2])))
"""


def test_a_task_that_fails_once_leaves_one_file(spark, tmp_path):
    folder = str(tmp_path / "t")
    run = subprocess.run([sys.executable, "-c", RETRY, ROOT, folder], capture_output=True, text=True, timeout=180)
    assert "FILES 4" in run.stdout, run.stderr[-2000:]
    assert len([n for n in os.listdir(folder) if n.startswith("part-")]) == 4 and len(os.listdir(folder)) == 5
    got = read_framed(spark, committed_files(folder), ["id"])
    assert sorted(int(r.id) for r in got.collect()) == list(range(40))
