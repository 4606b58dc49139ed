"""Moments, lognormal summaries, histograms, exact quantiles and correlations."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.functions.nulls import log_positive, ratio
from fieldledger.functions.normal import lognormal_mean, lognormal_mode, lognormal_pdf, lognormal_power_mean, spark_double
from fieldledger.operators.joins import BROADCAST_ROWS, dimension_join, summary_join, with_scalars
from fieldledger.operators.lineage import materialise


def group_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and sample standard deviation (NULL for a single value)."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )


def log_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Moments ``m, s`` of the log of the positive values."""
    x = log_positive(value)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))


def lognormal_summary(df: DataFrame, keys: list[str], value: str, power: float | None = None) -> DataFrame:
    """Lognormal mean, mode and (optionally) power mean from the log moments of each group."""
    out = log_moments(df, keys, value).withColumns({"mu": lognormal_mean("m", "s"), "mode": lognormal_mode("m", "s")})
    return out if power is None else out.withColumn("power_mean", lognormal_power_mean("m", "s", power))


def logmeanexp_center(df: DataFrame, cols: list[str]) -> DataFrame:
    """Subtract from each logged column the log of its mean level, so the level has mean one."""
    centers = df.agg(*[F.ln(F.avg(F.exp(c))).alias(f"_{c}") for c in cols])
    out = with_scalars(df, centers)
    return out.withColumns({c: F.col(c) - F.col(f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])


def summary_table(df: DataFrame, cols: list[str], dummies: list[str]) -> DataFrame:
    """Long table ``variable, stat, val`` of N, mean, sd, max, min; no sd for dummies.

    Computed as one wide aggregate that is reshaped afterwards, so no row is multiplied.
    """
    stats = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "max": F.max, "min": F.min}
    wide = df.agg(*[fn(c).cast("double").alias(f"{c}|{s}") for c in cols for s, fn in stats.items()])
    long = wide.unpivot([], wide.columns, "key", "val")
    parts = F.split("key", r"\|")
    out = long.select(parts[0].alias("variable"), parts[1].alias("stat"), "val")
    hide = F.col("variable").isin(dummies) & (F.col("stat") == "sd")
    return out.withColumn("val", F.when(~hide, F.col("val")))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, spans: DataFrame | None = None) -> DataFrame:
    """Equal-width bin counts per group over that group's range: ``bin`` from 1 to ``bins``.

    A group with a single value has its count in bin 1. Empty bins are not returned. ``spans`` passes on the ranges,
    ``lo`` and ``hi`` per group, where they are known.
    """
    data = df.filter(F.col(value).isNotNull()).select(*keys, value)
    if spans is None:
        spans = data.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    placed = summary_join(data, spans, keys) if keys else with_scalars(data, spans)
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.floor((F.col(value) - F.col("lo")) / width).cast("int") + 1
    bin_no = F.when(width > 0, F.least(raw, F.lit(bins))).otherwise(F.lit(1))
    return (
        placed.withColumn("bin", bin_no)
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.first("lo").alias("_lo"),
            F.first("hi").alias("_hi"),
        )
        .withColumn("mid", F.col("_lo") + (F.col("bin") - 0.5) * (F.col("_hi") - F.col("_lo")) / bins)
        .withColumn("width", (F.col("_hi") - F.col("_lo")) / bins)
        .drop("_lo", "_hi")
    )


def density_overlay(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Histogram density next to the fitted lognormal density at each bin mid-point."""
    positive = df.filter(F.col(value) > 0)
    logged = F.ln(value)
    # range and fit from one pass, kept as two steps need them
    known = materialise(
        positive.groupBy(*keys).agg(
            F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n_fit"), F.avg(logged).alias("m"), F.stddev_samp(logged).alias("s")
        )
    )
    bars = histogram(positive, keys, value, bins, known.select(*keys, "lo", "hi"))
    fit = known.drop("lo", "hi")
    # at most ``bins`` rows per group on one side and one on the other
    out = bars.join(fit, keys) if keys else with_scalars(bars, fit)
    return out.withColumns(
        {
            "density": F.col("n") / (F.col("n_fit") * F.col("width")),
            "fitted": lognormal_pdf("mid", "m", "s"),
        }
    )


#: Bits of a key that one pass of the radix selection counts, and rows of a bucket that a task may rank.
DIGIT, RANKED_ROWS = 16, 1 << 20


def with_order_key(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add a 64-bit integer that orders as the double does: its sign, exponent and mantissa, put together from the number.

    Equal numbers have equal keys, -0.0 and 0.0 too; different ones have different keys. NaN comes last, after infinity.
    """
    v = f"CAST(`{value}` AS DOUBLE)"
    # the logarithm may be one off next to a power of two, which is exact
    exact = "CASE WHEN _a < pow(2D, _g) THEN _g - 1 WHEN _a >= 2 * pow(2D, _g) THEN _g + 1 ELSE _g END"
    normal = "shiftleft(CAST(_e + 1023 AS BIGINT), 52) + CAST((_a / pow(2D, _e) - 1) * pow(2D, 52) AS BIGINT)"
    # a subnormal number counts its own units; two factors keep the scaling in range
    small = "CAST(_a * pow(2D, 537) * pow(2D, 537) AS BIGINT)"
    size = (
        "CASE WHEN isnan(_a) THEN 9221120237041090560 WHEN _a > 1.7976931348623157E308D THEN 9218868437227405312 "
        f"WHEN _a < 2.2250738585072014E-308D THEN {small} ELSE {normal} END"
    )
    guess = "CASE WHEN _a >= 2.2250738585072014E-308D AND _a <= 1.7976931348623157E308D THEN CAST(floor(log2(_a)) AS INT) END"
    out = df.withColumn("_a", F.expr(f"abs({v})")).withColumn("_g", F.expr(guess)).withColumn("_e", F.expr(exact))
    return out.withColumn(name, F.expr(f"({size}) * CASE WHEN {v} < 0 THEN -1 ELSE 1 END")).drop("_a", "_g", "_e")


def quantile_table(df: DataFrame, keys: list[str], value: str, probs: list[float], ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Exact interpolated quantiles (the convention of R's default) without gathering a group.

    Radix selection on order-preserving 64-bit keys: a pass counts the rows of each group per leading 16 bits, the
    running counts locate the buckets that hold the wanted ranks, and while one of these has more than
    ``ranked_rows`` rows the next 16 bits of its rows are counted. What is left is ranked within its bucket, equal values
    counted together first; so a task ranks at most ``ranked_rows`` different values however they are distributed.
    Missing values are left out; a missing group key is no group.
    """
    group = keys or ["_all"]
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    rows = rows if keys else rows.withColumn("_all", F.lit(1))
    keyed = with_order_key(rows.dropna("any", subset=group), "_v", "_k")
    needed, shift, small = wanted_buckets(keyed, group, probs, ranked_rows)
    placed = keyed.withColumn("_bucket", F.shiftright("_k", shift)).drop("_k")
    inside = dimension_join(placed, needed.drop("_n"), [*group, "_bucket"], small=small)
    counts = inside.groupBy(*group, "_bucket", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_start").alias("_start"), F.first("_ranks").alias("_ranks"))
    w = Window.partitionBy(*group, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_to", F.col("_start") + F.sum("_n").over(w)).withColumn("_from", F.col("_to") - F.col("_n"))
    hits = ranked.select(*group, "_v", "_from", "_to", F.explode("_ranks").alias("_r"))
    low = (F.col("_r.low") >= F.col("_from")) & (F.col("_r.low") < F.col("_to"))
    high = (F.col("_r.high") >= F.col("_from")) & (F.col("_r.high") < F.col("_to"))
    out = (
        hits.filter(low | high)
        .groupBy(*group, F.col("_r.prob").alias("prob"))
        .agg(
            F.max(F.when(low, F.col("_v"))).alias("_a"),
            F.max(F.when(high, F.col("_v"))).alias("_b"),
            F.first("_r.part").alias("_part"),
        )
        .withColumn("quantile", F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a")))
    )
    return out.select(*keys, "prob", "quantile")


def wanted_buckets(keyed: DataFrame, group: list[str], probs: list[float], ranked_rows: int) -> tuple[DataFrame, int, bool]:
    """Written table of the buckets that hold wanted ranks, ``group, _bucket, _start, _n, _ranks``; shift; whether it is small.

    ``_bucket`` is the key without its last ``shift`` bits, ``_start`` the number of smaller rows of the group. No
    bucket has more than ``ranked_rows`` rows unless all of them are equal. A group has at most two buckets per probability.
    """
    per = keyed.groupBy(*group, F.shiftright("_k", 64 - DIGIT).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    # at most 2 ** 16 rows of counts per group
    whole = Window.partitionBy(*group)
    located = per.withColumn("_total", F.sum("_n").over(whole)).withColumn("_start", _running("_n", group))
    listed = ", ".join(spark_double(p) for p in probs)
    ranks = F.expr(
        f"transform(transform(array({listed}), p -> named_struct('prob', p, 'at', (_total - 1) * p)), t -> "
        "named_struct('prob', t.prob, 'low', floor(t.at), 'high', ceil(t.at), 'part', t.at - floor(t.at)))"
    )
    needed = _holding(located.withColumn("_ranks", ranks), group)
    shift = 64 - DIGIT
    while True:
        needed = materialise(needed)
        found = needed.agg(F.max("_n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
        # a row holds its group, four numbers and the ranks
        small = found.rows * (len(probs) + 1) <= BROADCAST_ROWS
        if shift == 0 or (found.n or 0) <= ranked_rows:
            return needed, shift, small
        upper = needed.select(*group, F.col("_bucket").alias("_up"), F.col("_start").alias("_base"), "_ranks")
        rows = dimension_join(keyed.withColumn("_up", F.shiftright("_k", shift)), upper, [*group, "_up"], small=small)
        shift -= DIGIT
        finer = rows.groupBy(*group, "_up", F.shiftright("_k", shift).alias("_bucket")).agg(
            F.count(F.lit(1)).alias("_n"), F.first("_base").alias("_base"), F.first("_ranks").alias("_ranks")
        )
        needed = _holding(finer.withColumn("_start", F.col("_base") + _running("_n", [*group, "_up"])), group)


def _running(count: str, group: list[str]) -> Column:
    """Rows in the smaller buckets of the group."""
    w = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(w), F.lit(0))


def _holding(located: DataFrame, group: list[str]) -> DataFrame:
    """The buckets with a wanted rank, and which ranks these are."""
    end = F.col("_start") + F.col("_n")
    held = F.filter(
        "_ranks",
        lambda r: ((r["low"] >= F.col("_start")) & (r["low"] < end)) | ((r["high"] >= F.col("_start")) & (r["high"] < end)),
    )
    return located.withColumn("_ranks", held).filter(F.size("_ranks") > 0).select(*group, "_bucket", "_start", "_n", "_ranks")


def centred_products(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: ``n``, means ``m0..`` and centred cross products ``p0_0..`` of the columns over complete rows.

    The means are a scalar subquery of the same query, so both passes share the input's shuffles, and
    plain sums keep the compiled loop small.
    """
    complete = df.select(*cols).dropna("any").toDF(*[f"x{i}" for i in range(len(cols))])
    places = range(len(cols))
    # expressions as text: built call by call they cost the driver more than the query
    means = complete.agg(F.expr("count(1)").alias("n"), *[F.expr(f"avg(x{i})").alias(f"m{i}") for i in places])
    shifted = with_scalars(complete, means).selectExpr(
        "n", *[f"m{i}" for i in places], *[f"x{i} - m{i} AS c{i}" for i in places]
    )
    pairs = combinations_with_replacement(places, 2)
    sums = [F.expr(f"sum(c{i} * c{j}) AS p{i}_{j}") for i, j in pairs]
    return shifted.agg(F.expr("max(n) AS n"), *[F.expr(f"max(m{i}) AS m{i}") for i in places], *sums)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlations over complete rows as a long table ``var_a, var_b, r``."""
    moments = centred_products(df, cols)
    entries = []
    for i, j in combinations_with_replacement(range(len(cols)), 2):
        r = F.lit(1.0) if i == j else ratio(f"p{i}_{j}", F.sqrt(F.col(f"p{i}_{i}") * F.col(f"p{j}_{j}")))
        for a, b in {(i, j), (j, i)}:
            entries.append(F.struct(F.lit(cols[a]).alias("var_a"), F.lit(cols[b]).alias("var_b"), r.alias("r")))
    return moments.select(F.inline(F.array(*entries)))
