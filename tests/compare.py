"""Run registered queries next to their SQL twins and compare them as bags of rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(directory: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{directory}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return ("nan",)
    if v is None:
        return ("null",)
    return (type(v).__name__, v)


def _sorted_rows(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = [tuple(_norm(r[i]) for i in order) for r in rows]
    data.sort(key=repr)
    return [names[i] for i in order], data


def compare(spark, con, directory: str, query) -> str:
    """Empty when both results agree exactly, else the first difference."""
    df = query.build(spark, directory)
    ours = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        if node in plan:
            return f"plan has {node}"
    if query.sql is None:
        return "" if ours[1] else "no rows"
    cur = con.execute(query.sql)
    names = [c[0] for c in cur.description]
    theirs = _sorted_rows(names, cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    if not ours[1]:
        return "no rows"
    bad = [(a, b) for a, b in zip(*[ours[1], theirs[1]]) if repr(a) != repr(b)]
    return f"{len(bad)} of {len(ours[1])} rows differ, first {bad[0]}" if bad else ""


def main() -> int:
    from pyspark.sql import SparkSession

    from fieldledger.plans import REGISTRY

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.log.level", "ERROR")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    con, failed = duck(directory), 0
    for name, q in REGISTRY.items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, directory, q)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name:28} {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
