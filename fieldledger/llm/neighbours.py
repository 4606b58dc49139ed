"""Every document next to the one that follows it in descending order of ids, with one shuffle of the texts.

Ids alone are scanned for cut points, which deal the documents to ranges of ids. The first document of each range
also goes to the range before, so that a task which reads its range in order meets every document together with
its successor and holds two texts at a time. After the last document comes the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fieldledger.llm.rows import pieces, schema_of, ship_package, text_column

#: Ranges per shuffle partition: more ranges make the partitions more even.
RANGES = 4


def ranged(rows: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """Add ``part``: the range of each id, descending; rows without an id follow in ranges of their text's hash."""
    points = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(rows.select(F.col("id").cast("double")).approxQuantile("id", points, 1 / (2 * ranges))))
    hashed = F.floor((F.col("mark").cast("double") / F.lit(2.0**64) + 0.5) * ranges).cast("int")
    # the hashes run downwards too
    unnamed = F.lit(len(cuts) + 1 + ranges) - F.least(hashed, F.lit(ranges - 1))
    if not cuts:
        return rows.withColumn("part", F.when(F.col("id").isNull(), unnamed).otherwise(F.lit(0))), len(cuts)
    numbered = rows.withColumn("place", F.coalesce(F.col("id").cast("double"), F.lit(cuts[0])))
    split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="place", outputCol="range")
    part = F.when(F.col("id").isNull(), unnamed).otherwise(F.lit(len(cuts)) - F.col("range").cast("int"))
    return split.transform(numbered).withColumn("part", part).drop("place", "range"), len(cuts)


def with_next(docs: DataFrame, doc_id: str, text: str, ddl: str, make: Callable[[], Callable]) -> DataFrame:
    """Rows made by ``make()``'s functions ``(read, pair)`` from each document and its successor.

    ``read(text)`` is called once per document; ``pair(id, text, read, next_text, next_read)`` gives the output
    row. Documents are ordered by descending id, those without an id last; rows that share an id, and rows without one,
    by descending complement of the hash of the text. A single document follows itself.
    """
    spark = docs.sparkSession
    ship_package(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_column(text).alias("text"))
    rows = rows.withColumn("mark", F.bitwise_not(F.xxhash64("text")))
    dealt, _ = ranged(rows, RANGES * partitions)
    key: Column = F.struct("id", "mark")
    # one row per range: the bound is the number of ranges, not of documents
    firsts = sorted((r["part"], r["first"]) for r in dealt.groupBy("part").agg(F.max(key).alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], ddl)
    before = {part: firsts[i - 1][0] for i, (part, _) in enumerate(firsts)}
    wanted = spark.createDataFrame(
        [(part, first["id"], first["mark"], before[part]) for part, first in firsts], "part int, f_id bigint, f_mark bigint, before int"
    )
    same = (F.col("f_id").eqNullSafe(F.col("id"))) & (F.col("f_mark") == F.col("mark")) & (F.col("w.part") == F.col("d.part"))
    marked = dealt.alias("d").join(F.broadcast(wanted.alias("w")), same, "left")
    own = F.struct(F.col("d.part").alias("part"), F.lit(False).alias("guest"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("part"), F.lit(True).alias("guest"))))
    sent = marked.select("id", "text", "mark", F.explode(places).alias("p")).select("p.part", "p.guest", "id", "mark", "text")
    ordered = sent.repartition(partitions, "part").sortWithinPartitions(
        F.col("part"), F.col("guest"), F.col("id").desc_nulls_last(), F.col("mark").desc()
    )
    arrow = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, pair = make()
        held = None
        for batch in batches:
            for piece in pieces(batch):
                out = []
                for part, guest, i, t in zip(*(piece.column(c).to_pylist() for c in range(4)), strict=True):
                    if guest and (held is None or held[0] != part):
                        continue  # a second copy of the guest
                    now = (part, i, t, read(t))
                    if held is not None:
                        out.append(pair(held[1], held[2], held[3], t, now[3]))
                    held = None if guest else now
                if out:
                    columns = [pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), arrow.types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return ordered.select("part", "guest", "id", "text").mapInArrow(run, ddl)
