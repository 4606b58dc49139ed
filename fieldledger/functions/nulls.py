"""Null, zero and rounding policy shared by every operator.

R keeps -Inf, NaN and NA apart; Spark raises or returns NULL. The rules: a log of zero is 0 where
a zero quantity means "input not used" (``safe_log``), otherwise NULL (``log_positive``); a ratio
with a zero denominator is NULL; a sum over nothing is 0 where the survey meaning is "none".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c: Column | str) -> Column:
    """Missing number read as zero."""
    return F.coalesce(as_col(c), F.lit(0.0))


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``, NULL when the denominator is zero."""
    return F.try_divide(as_col(num), as_col(den))


def safe_log(c: Column | str) -> Column:
    """Natural log with log(0) = 0; negative and missing values give NULL."""
    c = as_col(c)
    return F.when(c == 0, F.lit(0.0)).when(c > 0, F.ln(c))


def log_positive(c: Column | str) -> Column:
    """Natural log of positive values, NULL otherwise."""
    c = as_col(c)
    return F.when(c > 0, F.ln(c))


def rounded(c: Column | str, digits: int) -> Column:
    """Round half up; the added zero turns a negative zero into zero."""
    return F.round(as_col(c), digits) + F.lit(0.0)
