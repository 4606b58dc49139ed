"""Normal and lognormal functions (Spark SQL has no ``erf``).

The distribution function is rendered once as SQL text: a parsed expression costs the driver far less
than building the same tree call by call, and the text also serves the SQL twins of the queries. The
arguments are therefore SQL expressions, best plain column names since they are repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldledger.functions.nulls import as_col

# Hart's double-precision rational approximation of the normal distribution function
# (J. F. Hart et al., Computer Approximations, 1968; published by G. West, 2005), highest power first.
HART_NUMERATOR = [
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
]
HART_DENOMINATOR = [
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
]
HART_TAIL_START = 7.07106781186547
SQRT_2PI = 2.5066282746310002


Literal = Callable[[float], str]


def spark_double(x: float) -> str:
    return f"{float(x)!r}D"


def _horner(coefs: list[float], x: str, lit: Literal) -> str:
    return reduce(lambda acc, c: f"({acc} * {x} + {lit(c)})", coefs[1:], lit(coefs[0]))


def pdf_text(z: str, lit: Literal = spark_double) -> str:
    return f"(exp(-({z}) * ({z}) / 2) / {lit(SQRT_2PI)})"


def cdf_text(z: str, lit: Literal = spark_double) -> str:
    """Standard normal distribution function of an SQL expression, absolute error about 1e-16."""
    x, density = f"abs({z})", f"exp(-({z}) * ({z}) / 2)"
    body = f"{density} * {_horner(HART_NUMERATOR, x, lit)} / {_horner(HART_DENOMINATOR, x, lit)}"
    fraction = reduce(lambda acc, k: f"({x} + {lit(k)} / {acc})", (4, 3, 2, 1), f"({x} + {lit(0.65)})")
    far = f"{density} / ({fraction} * {lit(SQRT_2PI)})"
    tail = f"(CASE WHEN {x} < {lit(HART_TAIL_START)} THEN {body} ELSE {far} END)"
    return f"(CASE WHEN ({z}) > 0 THEN {lit(1)} - {tail} ELSE {tail} END)"


def norm_pdf(z: str) -> Column:
    return F.expr(pdf_text(z))


def norm_cdf(z: str) -> Column:
    return F.expr(cdf_text(z))


def inverse_mills(z: str) -> Column:
    """Density over distribution function, the mean shift of an upper-truncated normal."""
    return F.expr(f"{pdf_text(z)} / {cdf_text(z)}")


def lognormal_pdf(x: str, m: str, s: str) -> Column:
    density = pdf_text(f"(ln({x}) - {m}) / {s}")
    return F.expr(f"CASE WHEN {x} > 0 THEN {density} / ({x} * {s}) ELSE 0.0D END")


def lognormal_cdf(x: str, m: str, s: str) -> Column:
    return F.expr(f"CASE WHEN {x} > 0 THEN {cdf_text(f'((ln({x}) - {m}) / {s})')} ELSE 0.0D END")


def lognormal_mean(m: Column | str, s: Column | str) -> Column:
    return lognormal_power_mean(m, s, F.lit(1.0))


def lognormal_mode(m: Column | str, s: Column | str) -> Column:
    m, s = as_col(m), as_col(s)
    return F.exp(m - s * s)


def lognormal_power_mean(m: Column | str, s: Column | str, power: Column | float) -> Column:
    """E[X^power] for ln X ~ N(m, s)."""
    m, s = as_col(m), as_col(s)
    return F.exp(m * power + s * s * power * power / 2)
