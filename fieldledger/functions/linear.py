"""Row-wise sums and dot products over column sets, built as one expression each."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldledger.functions.nulls import as_col, nz, ratio


def row_sum(cols: list[str]) -> Column:
    """Sum across columns with missing values read as zero."""
    return reduce(add, [nz(c) for c in cols])


def linear_score(coefs: dict[str, float], intercept: float = 0.0) -> Column:
    """Intercept plus the dot product of columns and named coefficients."""
    return reduce(add, [as_col(c) * F.lit(float(b)) for c, b in coefs.items()], F.lit(float(intercept)))


def masked_dot(coefs: dict[str, float]) -> Column:
    """Sum of the coefficients of the columns a row actually uses (value present and not zero)."""
    return reduce(
        add,
        [F.when(as_col(c) != 0, F.lit(float(b))).otherwise(F.lit(0.0)) for c, b in coefs.items()],
    )


def share_of(cols: list[str], suffix: str = "_share") -> dict[str, Column]:
    """Each column over the row total, for ``withColumns``."""
    total = row_sum(cols)
    return {f"{c}{suffix}": ratio(nz(c), total) for c in cols}
