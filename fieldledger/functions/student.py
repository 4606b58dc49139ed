"""Student's t distribution as a Column expression.

The two-sided p-value is the regularised incomplete beta function I_x(v/2, 1/2) at x = v / (v + t^2). Its continued
fraction is folded from the tail by ``aggregate``, a fixed number of terms that suffices up to ``LARGE`` degrees of
freedom. Above, t becomes a normal deviate by Wallace's formula, whose error falls with the square of the
degrees of freedom. The ratio of gamma functions in front comes from its asymptotic series, after a shift of the
argument to ten or more, so that it loses no digits at large arguments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldledger.functions.normal import cdf_text

TERMS, LARGE, SHIFT = 400, 4000, 10


def log_gamma_step(z: str) -> str:
    """``ln(gamma(z + 1/2) / gamma(z))``."""
    y = f"({z} + {SHIFT}D)"
    series = f"0.5D * ln({y}) - 1 / (8D * {y}) + 1 / (192D * pow({y}, 3)) - 1 / (640D * pow({y}, 5)) + 17 / (14336D * pow({y}, 7))"
    return f"({series} - aggregate(sequence(0, {SHIFT - 1}), 0D, (a, i) -> a + ln({z} + 0.5D + i) - ln({z} + i)))"


def fraction(a: str, b: str, x: str) -> str:
    """Continued fraction of the incomplete beta function, from its last term to its first."""
    even = f"m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m))"
    odd = f"-({a} + m - 1) * ({a} + {b} + m - 1) * {x} / (({a} + 2 * m - 2) * ({a} + 2 * m - 1))"
    return f"(1 / (1 + aggregate(sequence({TERMS}, 1, -1), 0D, (f, m) -> {odd} / (1 + {even} / (1 + f)))))"


def student_p(t: str, dof: str) -> Column:
    """Two-sided p-value from columns or SQL expressions; NULL without a statistic or degrees of freedom."""
    x, rest = "(s.v / (s.v + s.tt))", "(s.tt / (s.v + s.tt))"
    front = f"exp({log_gamma_step('(s.v / 2)')} - 0.5D * ln(pi()) + s.v / 2 * ln({x}) + 0.5D * ln({rest}))"
    # each fraction converges on its own side of the distribution's centre
    tail = f"{front} / (s.v / 2) * {fraction('(s.v / 2)', '0.5D', x)}"
    centre = f"1 - {front} / 0.5D * {fraction('0.5D', '(s.v / 2)', rest)}"
    exact = f"CASE WHEN {x} < (s.v / 2 + 1) / (s.v / 2 + 2.5D) THEN {tail} ELSE {centre} END"
    z = "-(8 * s.v + 1) / (8 * s.v + 3) * sqrt(s.v * log1p(s.tt / s.v))"
    normal = f"transform(array({z}), z -> 2 * {cdf_text('z')})[0]"
    body = f"CASE WHEN s.tt IS NULL OR NOT s.v > 0 THEN NULL WHEN s.tt = 0 THEN 1D WHEN s.tt > 1e200D THEN 0D WHEN s.v > {LARGE} THEN {normal} ELSE {exact} END"
    bound = f"named_struct('tt', CAST(({t}) * ({t}) AS DOUBLE), 'v', CAST({dof} AS DOUBLE))"
    return F.expr(f"transform(array({bound}), s -> {body})[0]")
