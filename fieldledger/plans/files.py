"""Files in the layouts of the study, landed in the shared folder from the given tables and read back."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import functions as F

from fieldledger.functions import parse_month_year, rounded
from fieldledger.operators.lineage import shared_folder
from fieldledger.plans.registry import query, rnd
from fieldledger.plans.views import MONTHLY_SQL, monthly_prices, table
from fieldledger.sources import framed, read_csv, write_csv
from fieldledger.sources.committed import write_committed
from fieldledger.sources.framed import locate, read_framed, write_lines
from fieldledger.sources.stata import read_stata


def landing(spark) -> str:
    return f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"


def framed_lines(rows, columns: list[str], above: list[str], below: list[str] = (), file: str | None = None):
    """Lines ``n, line`` (and ``file``): those above, the rows as delimited text, those below."""
    kept = [file] if file else []
    body = rows.select(*kept, F.lit(0).alias("n"), F.to_csv(F.struct(*columns)).alias("line"))
    names = rows.select(*kept).distinct() if file else rows.sparkSession.range(1)
    edges = [(i - len(above), t) for i, t in enumerate(above)] + [(i + 1, t) for i, t in enumerate(below)]
    array = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("line")) for i, t in edges])
    return body.unionByName(names.select(*kept, F.inline(array)))


@query(
    "titled_price_files",
    f"WITH {MONTHLY_SQL} SELECT market, date, {rnd('price', 8)} AS price FROM monthly",
)
def titled_price_files(spark, d):
    """One file per market: a title, an empty line, the header, rows dated ``January-2006``."""
    rows = monthly_prices(spark, d).select(
        F.regexp_replace("market", " ", "_").alias("town"),
        F.date_format("date", "MMMM-yyyy").alias("day"),
        F.format_string("%.10f", "price").alias("price"),
    )
    lines = framed_lines(rows, ["day", "price"], ["Price of an order per month, all towns", "", "Date,Price"], file="town")
    read = read_framed(spark, write_lines(lines, landing(spark), ["n"], file="town"), ["Date", "Price"], ["day", "price"])
    return read.select(
        F.regexp_replace(F.regexp_extract(F.url_decode("file"), "town=([^/]+)/", 1), "_", " ").alias("market"),
        parse_month_year("day").alias("date"),
        rounded(F.col("price").try_cast("double"), 8).alias("price"),
    )


@query(
    "promoted_header_file",
    f"SELECT s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey, {rnd('s_acctbal', 2)} AS s_acctbal FROM supplier",
)
def promoted_header_file(spark, d):
    """Two lines of metadata above the header, with fields that look like data."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    lines = framed_lines(rows, rows.columns, ["Source,Location,Zone,Level", "7,1902020,3,-1.5", "Key,Name,Nation,Balance"])
    read = read_framed(spark, write_lines(lines, landing(spark), ["n"]), ["Key", "Name", "Nation", "Balance"], rows.columns)
    return read.select(
        F.col("s_suppkey").cast("long").alias("s_suppkey"),
        "s_name",
        F.col("s_nationkey").cast("int").alias("s_nationkey"),
        rounded(F.col("s_acctbal").cast("double"), 2).alias("s_acctbal"),
    )


@query("trailing_header_file", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation")
def trailing_header_file(spark, d):
    """The header mangled as first line and as it should be as last."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    mangled, plain = ["nation..key.", "nation..name.", "region..key."], ["nation (key)", "nation (name)", "region (key)"]
    lines = framed_lines(rows, rows.columns, [",".join(mangled)], [",".join(plain)])
    read = read_framed(spark, write_lines(lines, landing(spark), ["n"]), mangled, rows.columns, plain)
    return read.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query(
    "thousands_file",
    """SELECT n_name AS county, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(round(sum(o_totalprice)) AS BIGINT) AS production,
       CASE WHEN sum(c_acctbal) < 0 THEN 0 ELSE 1 END AS valid
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def thousands_file(spark, d):
    """A byte-order mark, numbers with thousands separators in quotes, and a range check that empties bad values."""
    named = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("county"))
    homes = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    rows = (
        table(spark, d, "orders")
        .join(homes, "o_custkey")
        .join(named, "c_nationkey")
        .groupBy("county", F.year("o_orderdate").alias("yr"))
        .agg(F.format_number(F.round(F.sum("o_totalprice")), 0).alias("production"), F.format_number(F.sum("c_acctbal"), 2).alias("area"))
    )
    lines = framed_lines(rows, rows.columns, ["\ufeffCounty,Year,Production,Area"])
    read = read_framed(spark, write_lines(lines, landing(spark), ["n"]), ["County", "Year", "Production", "Area"], rows.columns)
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    return read.select(
        F.trim("county").alias("county"),
        F.col("yr").cast("int").alias("yr"),
        number("production").cast("long").alias("production"),
        F.when(number("area") < 0, 0).otherwise(1).alias("valid"),
    )


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    """A table written as delimited files by all tasks and read back under its schema."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    folder = landing(spark)
    write_csv(rows, folder)
    return read_csv(spark, folder, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("committed_round_trip", f"SELECT c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, {rnd('c_acctbal', 2)} AS c_acctbal FROM customer")
def committed_round_trip(spark, d):
    """A table written by all its tasks, committed by the driver, in files that repeat their header as last line."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").repartition(F.col("c_nationkey"))
    header = ["customer (key)", "name", "nation (key)", "balance, in full"]
    files = write_committed(rows, landing(spark), header, trailer=True)
    read = read_framed(spark, files, header, rows.columns, header)
    return read.select(
        F.col("c_custkey").cast("long").alias("c_custkey"),
        "c_name",
        F.col("c_nationkey").cast("int").alias("c_nationkey"),
        rounded(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"),
    )


def land_stata(rows, folder: str, labelled: list[str]) -> list[str]:
    """Write rows as Stata files, one per batch of a task, with value labels for some columns; the paths of the accepted attempts."""

    def write(batches):
        import pandas as pd

        for frame in batches:
            if len(frame):
                store, path = locate(f"{folder}/{uuid.uuid4().hex}.dta")
                store.create_dir(locate(folder)[1], recursive=True)
                with store.open_output_stream(path) as out:
                    frame.astype({c: "category" for c in labelled}).to_stata(out, write_index=False, version=114)
                yield pd.DataFrame({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"]})

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(framed)
    return sorted(r.path for r in rows.mapInPandas(write, "path string").collect())


@query("stata_round_trip", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def stata_round_trip(spark, d):
    """A table landed in the survey's file format, with a labelled column, and read back in ranges of rows."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return read_stata(spark, land_stata(rows, landing(spark), ["c_mktsegment"]), rows.columns)
