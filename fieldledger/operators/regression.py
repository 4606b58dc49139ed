"""Log-log regressions. Sufficient statistics come from one distributed pass and are solved inside the JVM."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.functions.linear import linear_score
from fieldledger.functions.nulls import ratio
from fieldledger.functions.student import student_p
from fieldledger.operators.joins import summary_join, with_scalars
from fieldledger.operators.lineage import materialise
from fieldledger.operators.linalg import dot, eigen, swept, varimax
from fieldledger.operators.moments import centred_products


def ols_fit(df: DataFrame, y: str, xs: list[str], intercept: bool = True) -> DataFrame:
    """Ordinary least squares over complete rows: one row per term with its standard error and p-value.

    One query: cross products, k by k whatever the number of rows, swept inside the JVM. Columns that do not vary or
    repeat earlier ones are left out, as R leaves out aliased terms. Without a complete row there are no terms; without
    a degree of freedom left there are no errors.
    """
    return fit_rows(gram(df, y, xs, intercept), xs, intercept)


def gram(df: DataFrame, y: str, xs: list[str], centred: bool = True) -> DataFrame:
    """One row over complete rows: ``n``, ``means`` and the flat cross products ``g`` of regressors and, last, response.

    Products are centred, or as they are for a fit without intercept.
    """
    cols = [*xs, y]
    if centred:
        row = centred_products(df, cols)
    else:
        pairs = combinations_with_replacement(range(len(cols)), 2)
        row = df.select(*cols).dropna("any").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
            *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in pairs],
        )
    return row.select(F.coalesce("n", F.lit(0)).alias("n"), flat_means(len(cols)), flat_products(len(cols)))


def flat_means(d: int) -> Column:
    return F.expr("array(" + ", ".join(f"coalesce(m{i}, 0D)" for i in range(d)) + ") AS means")


def flat_products(d: int) -> Column:
    cells = (f"CAST(coalesce(p{min(i, j)}_{max(i, j)}, 0) AS DOUBLE)" for i in range(d) for j in range(d))
    return F.expr("array(" + ", ".join(cells) + ") AS g")


def quoted(names: list[str]) -> str:
    """An SQL array of the names."""
    listed = (n.replace("\\", "\\\\").replace("'", "\\'") for n in names)
    return "array(" + ", ".join(f"'{n}'" for n in listed) + ")"


def fitted(one: DataFrame, k: int, use: str | None = None) -> DataFrame:
    """Add ``kept`` (swept columns), ``inverse`` (flat, d by d) and ``b`` (k coefficients, 0 for columns not swept).

    ``use`` names an array of k booleans: the columns that may enter.
    """
    d = k + 1
    allowed = use or f"array_repeat(true, {k})"
    out = one.withColumn("_s", F.expr(swept("g", d, allowed)))
    beta = f"transform(sequence(0, {k - 1}), i -> CASE WHEN array_contains(_s.kept, i) THEN _s.m[i * {d} + {k}] ELSE 0D END)"
    return out.withColumns({"kept": F.expr("_s.kept"), "inverse": F.expr("_s.m"), "b": F.expr(beta)}).drop("_s")


def fit_rows(one: DataFrame, xs: list[str], intercept: bool = True, use: str | None = None) -> DataFrame:
    """The fit of a ``gram`` row as a table: ``term, estimate, std_error, p_value, n, r2, r2_adj``."""
    k, d = len(xs), len(xs) + 1
    last = d * d - 1
    solved = fitted(one, k, use).withColumns(
        {
            "_dof": F.expr(f"n - {int(intercept)} - size(kept)"),
            "_r2": F.expr(f"1 - try_divide(inverse[{last}], g[{last}])"),
            "b0": F.expr(f"means[{k}] - {dot(k, 'b[i] * means[i]')}"),
        }
    )
    # variance of the intercept: 1 / n and the quadratic form of the means over the swept block
    form = dot(k, f"CASE WHEN array_contains(kept, i) THEN means[i] * aggregate(kept, 0D, (u, j) -> u + means[j] * inverse[i * {d} + j]) ELSE 0D END")
    named = quoted(xs)
    terms = f"transform(kept, i -> named_struct('term', {named}[i], 'estimate', b[i], 'scale', inverse[i * {d} + i]))"
    if intercept:
        terms = f"concat({terms}, array(named_struct('term', '(intercept)', 'estimate', b0, 'scale', 1D / n + {form})))"
    long = solved.filter("n > 0").select("n", "_dof", "_r2", F.expr(f"try_divide(greatest(inverse[{last}], 0D), _dof)").alias("_s2"), F.expr(f"inline({terms})"))
    errors = long.withColumn("std_error", F.sqrt(F.col("_s2") * F.col("scale")))
    return errors.select(
        "term",
        "estimate",
        "std_error",
        F.coalesce(student_p("try_divide(estimate, std_error)", "_dof"), F.expr("CASE WHEN std_error = 0 THEN 0D END")).alias("p_value"),
        "n",
        F.col("_r2").alias("r2"),
        F.expr(f"1 - (1 - _r2) * try_divide(n - {int(intercept)}, CAST(_dof AS DOUBLE))").alias("r2_adj"),
    )


def trimmed_gram(df: DataFrame, y: str, xs: list[str], limit: float) -> DataFrame:
    """The ``gram`` row without the rows whose residual exceeds the limit in size.

    The products of the trimmed rows are subtracted from those of all rows: after the fit one scan sums what goes,
    which is little, and nothing is summed again. Sums are taken about the means of all rows, so few digits cancel.
    """
    k, d = len(xs), len(xs) + 1
    cols = [*xs, y]
    one = materialise(fitted(gram(df, y, xs), k).select("n", "means", "g", "b"))
    rows = with_scalars(df.select(*cols).dropna("any"), one.select(F.col("means").alias("_means"), F.col("b").alias("_b")))
    shifted = rows.toDF(*[f"x{i}" for i in range(d)], "_means", "_b").selectExpr("_b", *[f"x{i} - _means[{i}] AS c{i}" for i in range(d)])
    gone = shifted.filter(f"abs(c{k} - {' - '.join(f'_b[{i}] * c{i}' for i in range(k))}) > {float(limit)!r}D")
    products = [f"coalesce(sum(c{min(i, j)} * c{max(i, j)}), 0D)" for i in range(d) for j in range(d)]
    taken = gone.agg(
        F.expr("count(1) AS m"),
        F.expr("array(" + ", ".join(f"coalesce(sum(c{i}), 0D)" for i in range(d)) + ") AS s"),
        F.expr("array(" + ", ".join(products) + ") AS q"),
    )
    left = with_scalars(one.drop("b"), taken)
    return left.select(
        F.expr("n - m").alias("n"),
        F.expr("transform(means, (v, i) -> v - coalesce(try_divide(s[i], n - m), 0D))").alias("means"),
        F.expr(f"transform(g, (v, x) -> v - q[x] - coalesce(try_divide(s[x div {d}] * s[x % {d}], n - m), 0D))").alias("g"),
    )


def trim_refit_multi(df: DataFrame, y: str, xs: list[str], limit: float = 1.0) -> DataFrame:
    """Fit on several regressors, drop rows whose residual exceeds the limit in size, and fit again."""
    return fit_rows(trimmed_gram(df, y, xs, limit), xs)


def input_selection(
    df: DataFrame, y: str, inputs: list[str], controls: list[str], limit: float | None = None, keep: str = "negative", steps: int | None = None
) -> DataFrame:
    """Refit while inputs have the unwanted sign: ``variable, is_input, first_estimate, estimate, dropped_at``.

    Every step drops all inputs whose coefficient has not the sign to ``keep`` and fits again, at most ``steps`` times
    (once per input unless given); ``dropped_at`` is the step, 0 for what stays. Controls always stay. With a limit, rows whose
    residual in the first fit exceeds it are left out throughout. Columns that repeat earlier ones have no estimate.
    All steps work on one matrix of cross products: the data are read for it, and once more for the trimming.
    """
    if keep not in ("negative", "positive"):
        raise ValueError("keep is negative or positive")
    xs = [*inputs, *controls]
    k, d = len(xs), len(xs) + 1
    one = materialise(gram(df, y, xs) if limit is None else trimmed_gram(df, y, xs, limit))
    sign = "<" if keep == "negative" else ">"
    wrong = f"f.use[i] AND i < {len(inputs)} AND NOT (array_contains(w.kept, i) AND w.m[i * {d} + {k}] {sign} 0)"
    after = f"named_struct('use', transform(sequence(0, {k - 1}), i -> f.use[i] AND NOT ({wrong})), 'at', transform(sequence(0, {k - 1}), i -> CASE WHEN {wrong} THEN e ELSE f.at[i] END))"
    step = f"transform(array({swept('g', d, 'f.use')}), w -> {after})[0]"
    start = f"named_struct('use', array_repeat(true, {k}), 'at', array_repeat(0, {k}))"
    count = len(inputs) if steps is None else steps
    fold = f"aggregate(sequence(1, {count}), {start}, (f, e) -> {step})" if count > 0 and inputs else start
    first = fitted(one, k).select("n", "means", "g", F.col("b").alias("b1"), F.col("kept").alias("kept1"))
    chosen = first.withColumn("_f", F.expr(fold)).withColumns({"use": F.expr("_f.use"), "at": F.expr("_f.at")})
    final = fitted(chosen, k, "use")
    named = quoted(xs)
    rows = (
        f"transform(sequence(0, {k - 1}), i -> named_struct('variable', {named}[i], 'is_input', i < {len(inputs)}, "
        "'first_estimate', CASE WHEN array_contains(kept1, i) THEN b1[i] END, "
        "'estimate', CASE WHEN array_contains(kept, i) THEN b[i] END, 'dropped_at', at[i]))"
    )
    return final.select(F.expr(f"inline({rows})"))


def gram_table(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Sums of products of intercept, regressors and response over complete rows, long."""
    base = df.select(y, *xs).dropna("any").withColumn("one", F.lit(1.0))
    cols = ["one", *xs, y]
    pairs = list(combinations_with_replacement(cols, 2))
    wide = base.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    parts = F.split("key", r"\|")
    return wide.unpivot([], wide.columns, "key", "total").select(
        parts[0].alias("var_a"), parts[1].alias("var_b"), "total"
    )


def ols_two(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Two-regressor fit in closed form from centred moments: slopes, intercept, R2, adjusted R2, errors."""
    c = df.select(y, a, b).dropna("any")
    m = c.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.avg(x).alias(f"m_{k}") for k, x in (("y", y), ("a", a), ("b", b))],
        F.covar_pop(a, a).alias("aa"),
        F.covar_pop(b, b).alias("bb"),
        F.covar_pop(a, b).alias("ab"),
        F.covar_pop(a, y).alias("ay"),
        F.covar_pop(b, y).alias("by"),
        F.covar_pop(y, y).alias("yy"),
    )
    col = F.col
    det = col("aa") * col("bb") - col("ab") * col("ab")
    fitted = m.withColumns(
        {
            "slope_a": ratio(col("bb") * col("ay") - col("ab") * col("by"), det),
            "slope_b": ratio(col("aa") * col("by") - col("ab") * col("ay"), det),
        }
    ).withColumns(
        {
            "intercept": col("m_y") - col("slope_a") * col("m_a") - col("slope_b") * col("m_b"),
            "r2": ratio(col("slope_a") * col("ay") + col("slope_b") * col("by"), "yy"),
        }
    )
    sigma2 = col("n") * col("yy") * (1 - col("r2")) / (col("n") - 3)
    return fitted.select(
        col("n").cast("long").alias("n"),
        "intercept",
        "slope_a",
        "slope_b",
        "r2",
        (1 - (1 - col("r2")) * (col("n") - 1) / (col("n") - 3)).alias("r2_adj"),
        F.sqrt(sigma2 * ratio("bb", det) / col("n")).alias("se_a"),
        F.sqrt(sigma2 * ratio("aa", det) / col("n")).alias("se_b"),
    )


def simple_fit(df: DataFrame, y: str, x: str, keys: list[str] | None = None) -> DataFrame:
    """Simple regression, overall or per group: slope, intercept, R2, adjusted R2, degrees of freedom."""
    ok = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = ok.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
    return fit.withColumns(
        {
            "r2_adj": 1 - (1 - F.col("r2")) * ratio((F.col("n") - 1).cast("double"), (F.col("n") - 2).cast("double")),
            "df": F.col("n") - 2,
        }
    )


def slope_through_origin(df: DataFrame, y: str, x: str, keys: list[str] | None = None) -> DataFrame:
    ok = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    return ok.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope"),
    )


def with_residuals(df: DataFrame, y: str, x: str, keys: list[str] | None = None) -> DataFrame:
    """Fitted values and residuals of the simple regression, overall or per group."""
    fit = simple_fit(df, y, x, keys).select(*(keys or []), F.col("slope").alias("_b"), F.col("intercept").alias("_a"))
    ok = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    joined = summary_join(ok, fit, keys) if keys else with_scalars(ok, fit)
    return (
        joined.withColumn("fitted", F.col("_a") + F.col("_b") * F.col(x))
        .withColumn("residual", F.col(y) - F.col("fitted"))
        .drop("_a", "_b")
    )


def trim_refit(df: DataFrame, y: str, x: str, limit: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Fit, drop rows whose residual exceeds the limit in size, and fit again."""
    kept = with_residuals(df, y, x, keys).filter(F.abs("residual") <= limit).drop("fitted", "residual")
    return simple_fit(kept, y, x, keys)


def residual_summary(df: DataFrame, y: str, x: str, keys: list[str] | None = None) -> DataFrame:
    """Residual sum of squares and deviation, from the fit's own moments in a single pass."""
    ok = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    left = F.var_samp(y) * (1 - F.regr_r2(y, x))
    return ok.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.count(F.lit(1)) - 1) * left).alias("rss"),
        F.sqrt(F.greatest(left, F.lit(0.0))).alias("sd_residual"),
    )


def smearing(df: DataFrame, y: str, x: str, cost: str, adjust: tuple[str, float] | None = None) -> DataFrame:
    """Expected level from a log fit, ``exp(fitted + var / 2)``, and the unit cost it implies.

    ``adjust`` names a logged control and its coefficient to take out of the expectation.
    """
    spread = residual_summary(df, y, x).select(F.col("sd_residual").alias("_s"))
    out = with_scalars(with_residuals(df, y, x), spread)
    shift = F.lit(0.0) if adjust is None else F.lit(adjust[1]) * F.col(adjust[0])
    return (
        out.withColumn("expected", F.exp(F.col("fitted") - shift + F.col("_s") * F.col("_s") / 2))
        .withColumn("unit_cost", ratio(cost, "expected"))
        .drop("_s")
    )


def negative_terms(fit: DataFrame, inputs: list[str]) -> tuple[list[str], list[str]]:
    """Inputs split by the sign of their coefficient (positive, negative); the table has one row per term."""
    estimates = {r.term: r.estimate for r in fit.select("term", "estimate").collect()}
    negative = [c for c in inputs if estimates.get(c, 0.0) < 0]
    return [c for c in inputs if c not in negative], negative


def predict(df: DataFrame, fit: DataFrame, name: str = "fitted") -> DataFrame:
    """Score rows with a fitted coefficient table."""
    est = {r.term: r.estimate for r in fit.select("term", "estimate").collect()}
    b0 = est.pop("(intercept)", 0.0)
    return df.withColumn(name, linear_score(est, b0))


def pca_loadings(df: DataFrame, cols: list[str], keep: float = 0.8) -> DataFrame:
    """Varimax-rotated loadings of the leading components of the correlation matrix.

    Components are kept until they explain ``keep`` of the variance, rounded to two digits. The correlations are a
    distributed aggregate; the k by k problem is solved by rotations inside the JVM. Columns of loadings are turned
    to a sum that is not negative. A column that does not vary correlates with nothing.
    """
    k = len(cols)
    moments = centred_products(df, cols)
    cells = (
        "1D" if i == j else f"coalesce(try_divide(p{min(i, j)}_{max(i, j)}, sqrt(p{i}_{i} * p{j}_{j})), 0D)" for i in range(k) for j in range(k)
    )
    solved = moments.selectExpr("array(" + ", ".join(cells) + ") AS corr").withColumn("e", F.expr(eigen("corr", k)))
    order = f"array_sort(transform(sequence(0, {k - 1}), i -> named_struct('minus', -e.a[i * {k + 1}], 'at', i)))"
    ranked = solved.withColumn("o", F.expr(order)).withColumn(
        "share", F.expr(f"transform(sequence(0, {k - 1}), j -> aggregate(slice(o, 1, j + 1), 0D, (t, r) -> t - r.minus) / {k})")
    )
    ranked = ranked.withColumn("n", F.expr(f"coalesce(nullif(array_position(transform(share, s -> round(s, 2) >= {keep!r}D), true), 0), {k})").cast("int"))
    cell = f"e.v[(x div n) * {k} + o[x % n].at] * sqrt(greatest(-o[x % n].minus, 0D))"
    loaded = ranked.withColumn("l", F.expr(f"transform(sequence(0, {k} * n - 1), x -> {cell})"))
    loaded = loaded.withColumn("l", F.expr(f"transform(l, (v, x) -> v * {upright('l', k)})"))
    # rows to unit length and back: Kaiser's normalisation
    length = f"transform(sequence(0, {k - 1}), i -> sqrt(aggregate(slice(l, i * n + 1, n), 0D, (t, v) -> t + v * v)))"
    scaled = loaded.withColumn("len", F.expr(length)).withColumn(
        "unit", F.expr("transform(l, (v, x) -> v / CASE WHEN len[x div n] = 0 THEN 1D ELSE len[x div n] END)")
    )
    turned = scaled.withColumn("r", F.expr(varimax("unit", k, "n"))).withColumn("r", F.expr("transform(r, (v, x) -> v * len[x div n])"))
    turned = turned.withColumn("r", F.expr(f"transform(r, (v, x) -> v * {upright('r', k)})"))
    named = quoted(cols)
    rows = (
        f"transform(l, (v, x) -> named_struct('variable', {named}[x div n], 'component', x % n + 1, 'loading', v, "
        "'rotated', r[x], 'eigenvalue', -o[x % n].minus, 'cum_share', share[x % n]))"
    )
    return turned.select(F.expr(f"inline({rows})"))


def upright(m: str, k: int) -> str:
    """1 or -1: the sign that gives the column of element x of a k by n matrix a sum that is not negative."""
    return f"CASE WHEN aggregate(sequence(0, {k - 1}), 0D, (t, i) -> t + {m}[i * n + x % n]) < 0 THEN -1D ELSE 1D END"


def logistic_fit(df: DataFrame, y: str, xs: str | list[str], steps: int = 25, tol: float = 1e-10) -> DataFrame:
    """Logistic curve through a response in [0, 1]: ``term, estimate``.

    Newton's method on the likelihood: each step is one aggregate over the rows, of which the k by k system reaches the
    driver; a step that lowers the likelihood is halved. Where the rows are separated, so that the likelihood has no
    maximum, or without a solution within the given steps, the estimates are NULL.
    """
    xs = [xs] if isinstance(xs, str) else xs
    rows = materialise(df.select(F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)]).dropna("any"))
    at = ["1D", *[f"_x{i}" for i in range(len(xs))]]
    beta, last, best = np.zeros(len(at)), None, None
    for _ in range(steps):
        n, loss, gradient, system = logistic_step(rows, at, beta)
        if not n or loss < 1e-6 * n:
            break
        if last is not None and loss > last + tol * abs(last):
            beta = (beta + best) / 2
            continue
        if np.linalg.cond(system) > 1e14:
            break
        move = np.linalg.solve(system, gradient)
        if last is not None and abs(last - loss) <= tol * abs(loss) and np.abs(move).max() <= 1e-8 * (1 + np.abs(beta).max()):
            return _terms(df, xs, [float(b) for b in beta + move])
        last, best, beta = loss, beta, beta + move
    return _terms(df, xs, [None] * len(at))


def _terms(df: DataFrame, xs: list[str], estimates: list[float | None]) -> DataFrame:
    rows = list(zip(["(intercept)", *xs], estimates, strict=True))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double")


def logistic_step(rows: DataFrame, at: list[str], beta: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Rows, negative log likelihood, gradient and information at the given coefficients, from one aggregate."""
    eta = " + ".join(f"{float(b)!r}D * {x}" for b, x in zip(beta, at, strict=True))
    mid = rows.withColumn("_eta", F.expr(eta)).withColumn("_mu", F.expr("1 / (1 + exp(-_eta))"))
    k = len(at)
    row = mid.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.expr("greatest(_eta, 0D) + log1p(exp(-abs(_eta))) - _y * _eta")).alias("loss"),
        *[F.sum(F.expr(f"(_y - _mu) * {x}")).alias(f"g{i}") for i, x in enumerate(at)],
        *[F.sum(F.expr(f"_mu * (1 - _mu) * {at[i]} * {at[j]}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)],
    ).first()
    if not row.n:
        return 0, 0.0, np.zeros(k), np.eye(k)
    system = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return row.n, row.loss, np.array([row[f"g{i}"] for i in range(k)]), system


def cross_ratio(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean and spread of the log ratio of column pairs, in one pass, long: ``pair, n, mean, sd``."""
    aggs = []
    for a, b in pairs:
        x = F.when((F.col(a) > 0) & (F.col(b) > 0), F.ln(F.col(a)) - F.ln(F.col(b)))
        aggs.append(
            F.struct(
                F.lit(f"{a}/{b}").alias("pair"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("sd"),
            )
        )
    return df.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))

