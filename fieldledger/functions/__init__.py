"""Column builders. Everything here is a JVM-side expression, nothing is a UDF."""

from fieldledger.functions.dates import month_start, parse_day, parse_month_year, season_year
from fieldledger.functions.linear import linear_score, masked_dot, row_sum, share_of
from fieldledger.functions.labels import endowment_label, list_recode, substring_recode, title_case, unit_factor
from fieldledger.functions.nulls import log_positive, nz, ratio, rounded, safe_log
from fieldledger.functions.normal import (
    inverse_mills,
    lognormal_cdf,
    lognormal_mean,
    lognormal_mode,
    lognormal_pdf,
    lognormal_power_mean,
    norm_cdf,
    norm_pdf,
)

__all__ = [
    "endowment_label",
    "inverse_mills",
    "linear_score",
    "list_recode",
    "log_positive",
    "lognormal_cdf",
    "lognormal_mean",
    "lognormal_mode",
    "lognormal_pdf",
    "lognormal_power_mean",
    "masked_dot",
    "month_start",
    "norm_cdf",
    "norm_pdf",
    "nz",
    "parse_day",
    "parse_month_year",
    "ratio",
    "rounded",
    "row_sum",
    "safe_log",
    "season_year",
    "share_of",
    "substring_recode",
    "title_case",
    "unit_factor",
]
