"""Recover the moments of a full lognormal population from a truncated sample.

For ln X ~ N(m, s) cut from above at u, with z = (ln u - m) / s and r = pdf(z) / cdf(z), the sample
moments satisfy t = (ln u - mean) / sd = (z + r) / sqrt(1 - r (z + r)). The right side rises with z from 1 and is
never below z, so the root lies below t; and it is about 1 + 1 / z^2 far below zero, so the root lies above
-2 / sqrt(t - 1) - 2. Between these ends of its own each row is bisected, one fixed-length fold inside the JVM;
then s = (ln u - mean) / (z + r) and m = ln u - z s. Next to 1, where the right side cannot be told from its limit
in double precision, z = -1 / sqrt(t - 1). A ratio of one or less has no root and gives NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.functions.normal import Literal, cdf_text, pdf_text, spark_double

STEPS = 80
# ratios closer to one take the root of the leading term
NEAR_ONE = 1e-6
# below this the distribution function is so small that z + r is taken from its continued fraction
FRACTION_BELOW, FRACTION_TERMS = -5.0, 40


def mean_gap_text(z: str, lit: Literal = spark_double) -> str:
    """``z + pdf(z) / cdf(z)``, the distance of the cut from the truncated mean in units of s."""
    fraction = reduce(lambda acc, k: f"({lit(k)} / (-{z} + {acc}))", range(FRACTION_TERMS, 0, -1), lit(0))
    body = f"{z} + {pdf_text(z, lit)} / {cdf_text(z, lit)}"
    return f"(CASE WHEN {z} < {lit(FRACTION_BELOW)} THEN {fraction} ELSE {body} END)"


def solve_cut(target: str) -> Column:
    """z whose gap in truncated standard deviations equals the target column."""
    # one-element arrays bind the mid-point and its gap once per step
    step = (
        f"transform(array((a.lo + a.hi) / 2), z -> transform(array({mean_gap_text('z')}), g -> "
        f"CASE WHEN g / sqrt(1 - (g - z) * g) < {target} THEN named_struct('lo', z, 'hi', a.hi) "
        "ELSE named_struct('lo', a.lo, 'hi', z) END)[0])[0]"
    )
    start = f"named_struct('lo', -2D / sqrt({target} - 1) - 2D, 'hi', {target})"
    root = f"aggregate(sequence(1, {STEPS}), {start}, (a, i) -> {step}, a -> (a.lo + a.hi) / 2)"
    far = f"-1D / sqrt({target} - 1)"
    return F.expr(f"CASE WHEN {target} > 1 + {spark_double(NEAR_ONE)} THEN {root} WHEN {target} > 1 THEN {far} END")


def untruncate_upper(moments: DataFrame, m_bar: str, s_bar: str, cut: str) -> DataFrame:
    """Add ``z, m, s`` of the full population to rows of truncated log moments, cut from above."""
    return _untruncate(moments, F.ln(cut) - F.col(m_bar), s_bar, cut, 1.0)


def untruncate_lower(moments: DataFrame, m_bar: str, s_bar: str, cut: str) -> DataFrame:
    """As ``untruncate_upper`` for samples cut from below: the mirror image of the logs."""
    return _untruncate(moments, F.col(m_bar) - F.ln(cut), s_bar, cut, -1.0)


def _untruncate(moments: DataFrame, gap: Column, s_bar: str, cut: str, side: float) -> DataFrame:
    # gap, ratio and root become columns one after another, so that none is expanded into the next
    solved = moments.withColumn("_gap", gap).withColumn("_t", F.try_divide("_gap", s_bar))
    solved = solved.withColumn("z", solve_cut("_t")).drop("_t")
    return (
        solved.withColumn("s", F.col("_gap") / F.expr(mean_gap_text("z")))
        .withColumn("m", F.ln(cut) - F.lit(side) * F.col("z") * F.col("s"))
        .drop("_gap")
    )
