"""Equi-joins that hold up when one key carries a large part of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.operators.lineage import materialise

# A small side is broadcast only after its rows and bytes have been summed and exceed neither.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20
SALT = "_salt"
#: Joins whose frequent keys can be split off, and the most keys that are.
SPLIT_KINDS, MOST_HOT = ("inner", "left", "left_semi", "left_anti"), 10_000


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def value_bytes(name: str, kind: str) -> Column:
    """About what a value takes: the bytes of a string, eight for a number, so many per entry of an array or map."""
    c = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if kind.startswith(("array", "map")):
        return F.greatest(F.size(c), F.lit(0)) * 16 + 8
    return F.lit(16 if kind.startswith("struct") else 8)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether rows and bytes stay within the bounds: one aggregate, added up where the rows are."""
    width = reduce(lambda a, b: a + b, [value_bytes(c, kind) for c, kind in df.dtypes])
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return found.n <= max_rows and (found.b or 0) <= max_bytes


def join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on named keys. ``null_safe`` lets a missing key match a missing key."""
    if not null_safe:
        return a.join(b, keys, how)
    renamed = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return a.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name the two tables share; inner and left joins split hot keys."""
    return _natural(a, b, how)[0]


def _natural(a: DataFrame, b: DataFrame, how: str) -> tuple[DataFrame, bool]:
    keys = shared_columns(a, b)
    if not keys:
        raise ValueError("tables share no column")
    return _split(a, b, keys, how) if how in SPLIT_KINDS else (a.join(b, keys, how), False)


def left_join_chain(first: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Left join a list of tables, one after another, on the names each shares with the result so far.

    Every look for hot keys reads the result so far. So the first table is written before the first such look, and
    a result whose hot keys were split before the next join reads its parts again.
    """
    out = first if all(may_broadcast(other) for other in others) else materialise(first)
    for i, other in enumerate(others):
        out, parted = _natural(out, other, "left")
        if parted and i + 1 < len(others):
            out = materialise(out)
    return out


def may_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer would broadcast this side of a join by itself; then no key needs care."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def key_hash(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """The same hash for keys that a join of the two tables takes as equal, whatever their types on either side."""
    kinds = a.select(*keys).limit(0).union(b.select(*keys).limit(0)).dtypes
    # adding zero makes a negative zero positive
    return F.xxhash64(*[F.col(k).cast(t) + F.lit(0.0) if t in ("double", "float") else F.col(k).cast(t) for k, t in kinds])


def frequent_keys(rows: DataFrame, keys: list[str], mark: Column | None = None) -> tuple[list[int], bool]:
    """Hashes of the keys that would fill half a shuffle partition or more, and whether missing keys would.

    One scan: a mergeable sketch of frequent items, of a size that depends on the number of partitions alone, in
    place of a count per key. A key that is listed without need does no harm.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(2 * partitions, MOST_HOT)
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in keys])
    marks = rows.select(F.when(whole, F.xxhash64(*keys) if mark is None else mark).alias("h"))
    found = marks.agg(F.count(F.lit(1)).alias("n"), F.count("h").alias("named"), F.expr(f"approx_top_k(h, {k}, {4 * k})").alias("top")).first()
    least = found.n / (2 * partitions)
    return [t["item"] for t in found.top or [] if t["item"] is not None and t["count"] > least], found.n - found.named > least


def split_join(fact: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which frequent keys are split off, for inner, left, left_semi and left_anti.

    Rows of ``fact`` with a frequent key stay where they are and meet the few rows of ``other`` with these keys
    by a broadcast of checked size; rows with a missing key, which match nothing, are not shuffled at all; the
    rest meet by a shuffle. So neither equal rows nor missing keys gather in one task, and no row's place depends on
    anything but its key. Where frequent keys have many rows in ``other`` too, adaptive execution is left to
    split them.
    """
    return _split(fact, other, keys, how)[0]


def _split(fact: DataFrame, other: DataFrame, keys: list[str], how: str) -> tuple[DataFrame, bool]:
    if how not in SPLIT_KINDS:
        raise ValueError(f"split_join supports {', '.join(SPLIT_KINDS)}")
    if may_broadcast(other):
        return fact.join(other, keys, how), False
    mark = key_hash(fact, other, keys)
    hashes, missing = frequent_keys(fact, keys, mark)
    loose = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in keys])
    named = fact.filter(~loose) if missing else fact
    parts = []
    if hashes:
        hot = F.broadcast(fact.sparkSession.createDataFrame([(h,) for h in hashes], "_hot bigint"))
        is_hot = mark == F.col("_hot")
        few = materialise(other.join(hot, is_hot, "left_semi"))
        if is_small(few):
            parts.append(named.join(hot, is_hot, "left_semi").join(F.broadcast(few), keys, how))
            named, other = named.join(hot, is_hot, "left_anti"), other.join(hot, is_hot, "left_anti")
    parts.append(named.join(other, keys, how))
    if missing and how in ("left", "left_anti"):
        parts.append(fact.filter(loose).join(F.broadcast(other.filter(F.lit(False))), keys, how))
    return reduce(lambda x, y: x.union(y), parts), len(parts) > 1


def dimension_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    small: bool | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join to a table with one row per key: broadcast if its summed size allows, else salted.

    ``small`` passes on a size check already made; ``counts`` as for ``salted_join``.
    """
    if is_small(dim, max_rows) if small is None else small:
        return fact.join(F.broadcast(dim), keys, how)
    return salted_join(fact, dim, keys, how, counts=counts)


def summary_join(
    fact: DataFrame, summary: DataFrame, keys: list[str], how: str = "inner", rows: str | None = None
) -> DataFrame:
    """Join rows to an aggregate of themselves.

    The aggregate is written out first, so that the size check and the join read it, not its input.
    ``rows`` names its column with the number of rows per key, if it has one.
    """
    kept = materialise(summary)
    counts = None if rows is None else kept.select(*keys, F.col(rows).alias("_n"))
    return dimension_join(fact, kept, keys, how, counts=counts)


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "inner",
    salts: int = 64,
    hot_share: float = 0.002,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join with the rows of hot keys spread over ``salts`` tasks.

    A key is hot above ``hot_share`` of all fact rows, so there are at most ``1 / hot_share`` of them
    and their list is always small. The salt is a hash of the row, so a retried task repeats it.
    ``counts`` gives the fact rows ``_n`` of each key where they are known already.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    if counts is None:
        per_key = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        total = per_key.agg(F.sum("_n").alias("n")).scalar()
    else:
        per_key, total = counts, fact.agg(F.count(F.lit(1)).alias("n")).scalar()
    hot = per_key.filter(F.col("_n") > total * hot_share).select(*keys, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in fact.columns]), F.lit(salts)).cast("int")
    # rows with a missing key match nothing, wherever they go
    loose = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    left = (
        fact.join(hot, keys, "left")
        .withColumn(SALT, F.when(F.col("_hot") | loose, spread).otherwise(F.lit(0)))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = dim.join(hot, keys, "left").withColumn(SALT, F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, SALT], how).drop(SALT)


def anti_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose key is absent from ``b``; a missing key is absent."""
    return split_join(a, b.select(*keys).distinct(), keys, "left_anti")


def semi_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose key is present in ``b``."""
    return split_join(a, b.select(*keys).distinct(), keys, "left_semi")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate as scalar subqueries (no join)."""
    row = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("r")).scalar()
    # one subquery in the plan, from which every column is taken
    out = df.withColumn("_row", row)
    return out.withColumns({c: F.col("_row").getField(c) for c in one_row.columns}).drop("_row")


def grid_axis(start: float, stop: float, n: int):
    """Evenly spaced values from ``start`` to ``stop`` as an array column of (index, value)."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(i.alias("ix"), (F.lit(float(start)) + i * F.lit(step)).alias("value")),
    )


def with_grid(df: DataFrame, name: str, start: float, stop: float, n: int, index: str | None = None) -> DataFrame:
    """Repeat each row once per grid value: the fixed-size grid is generated in place, nothing is joined."""
    out = df.withColumn("_g", F.explode(grid_axis(start, stop, n)))
    out = out.withColumn(name, F.col("_g.value"))
    if index:
        out = out.withColumn(index, F.col("_g.ix"))
    return out.drop("_g")


def with_levels(df: DataFrame, name: str, levels: list) -> DataFrame:
    """Repeat each row once per listed scenario value."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
