"""Date parsing and calendar keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldledger.functions.nulls import as_col


def parse_month_year(c: Column | str) -> Column:
    """``January-2006`` to the first day of that month, NULL when it is not such a date."""
    return F.try_to_timestamp(as_col(c), F.lit("MMMM-yyyy")).cast("date")


def parse_day(c: Column | str, pattern: str) -> Column:
    """Day date under an explicit pattern (``M/d/yyyy``, ``yyyy-MM-dd``, ``d/M/yyyy``)."""
    return F.try_to_timestamp(as_col(c), F.lit(pattern)).cast("date")


def month_start(c: Column | str) -> Column:
    return F.trunc(as_col(c), "month")


def season_year(c: Column | str, anchor_month: int) -> Column:
    """Year in which the season holding this date began (seasons begin in ``anchor_month``)."""
    c = as_col(c)
    return F.year(c) - (F.month(c) < anchor_month).cast("int")
