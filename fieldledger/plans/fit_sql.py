"""SQL twins of the multivariate fits: plain algorithms, other than those of the operators.

Normal equations with the intercept among the columns, solved by Gauss-Jordan elimination as a recursive query;
p-values by Simpson's rule; eigenvectors and simple structure by rotations as recursive queries; Newton steps likewise.
"""

from __future__ import annotations

from fieldledger.plans.registry import rnd


def normal_equations(name: str, source: str, y: str, xs: list[str]) -> str:
    """Table of one row: ``n``, ``syy``, ``sy`` and ``m``, rows of [X'X | X'y | I] with the intercept first."""
    cols = ["1.0::DOUBLE", *[f"{x}::DOUBLE" for x in xs]]
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])
    cells = []
    for i, a in enumerate(cols):
        cells += [f"sum({a} * {b})" for b in cols] + [f"sum({a} * {y})"]
        cells += ["1.0" if i == j else "0.0" for j in range(len(cols))]
    return f"""{name} AS (SELECT CAST(count(*) AS BIGINT) AS n, sum({y} * {y}) AS syy, sum({y}) AS sy,
  [{", ".join(f"CAST({c} AS DOUBLE)" for c in cells)}] AS m FROM {source} WHERE {complete})"""


def masked(use: str, k: int) -> str:
    """The matrix with the columns that ``use`` (a list of booleans, regressors only) leaves out made trivial."""
    w = 2 * k + 3
    row, column = f"(x // {w})", f"(x % {w})"
    out = f"(({row} > 0 AND NOT {use}[{row}]) OR ({column} BETWEEN 1 AND {k} AND NOT {use}[{column}]))"
    return f"list_transform(range({(k + 1) * w}), lambda x: CASE WHEN {column} <= {k + 1} AND {out} THEN CASE WHEN {row} = {column} THEN 1.0 ELSE 0.0 END ELSE m[x + 1] END)"


def eliminated(name: str, source: str, k: int, m: str = "m") -> str:
    """Gauss-Jordan elimination: ``name`` has ``b`` (intercept first) and the inverse's diagonal ``d``."""
    w = 2 * k + 3
    pivot = f"m[p * {w} + p + 1]"
    step = (
        f"list_transform(range({(k + 1) * w}), lambda x: CASE WHEN x // {w} = p THEN m[x + 1] / {pivot} "
        f"ELSE m[x + 1] - m[(x // {w}) * {w} + p + 1] * m[p * {w} + x % {w} + 1] / {pivot} END)"
    )
    return f"""{name}_steps AS (SELECT 0 AS p, {m} AS m FROM {source} UNION ALL SELECT p + 1, {step} FROM {name}_steps WHERE p <= {k}),
{name} AS (SELECT list_transform(range({k + 1}), lambda i: m[i * {w} + {k + 2}]) AS b,
  list_transform(range({k + 1}), lambda i: m[i * {w} + {k + 2} + i + 1]) AS d FROM {name}_steps WHERE p = {k + 1})"""


def fit_select(fit: str, equations: str, xs: list[str], digits: int = 6) -> str:
    """The table of a fit from its equations and elimination."""
    k, w = len(xs), 2 * len(xs) + 3
    explained = f"list_sum(list_transform(range({k + 1}), lambda i: b[i + 1] * m[i * {w} + {k + 2}]))"
    wave = lambda hi, n: (
        f"(({hi}) / {n} / 3 * list_sum(list_transform(range({n + 1}), lambda i: "
        f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(({hi}) * i / {n}), dof - 1))))"
    )
    named = ", ".join(f"'{t}'" for t in ["(intercept)", *xs])
    return f"""SELECT term, {rnd('estimate', digits)} AS estimate, {rnd('se', digits)} AS std_error,
  {rnd('1 - ' + wave('atan(abs(estimate / se) / sqrt(dof))', 4000) + ' / ' + wave('pi() / 2', 20000), digits)} AS p_value, n,
  {rnd('1 - rss / tss', digits)} AS r2, {rnd(f'1 - rss / tss * (n - 1) / dof', digits)} AS r2_adj
FROM (SELECT unnest([{named}]) AS term, unnest(b) AS estimate, unnest(list_transform(d, lambda v: sqrt(rss / dof * v))) AS se, n, dof, rss, tss
  FROM (SELECT *, syy - {explained} AS rss, syy - sy * sy / n AS tss, CAST(n - {k + 1} AS DOUBLE) AS dof FROM {fit}, {equations}))"""


def score(b: str, xs: list[str]) -> str:
    return f"{b}[1] + " + " + ".join(f"{b}[{i + 2}] * {x}" for i, x in enumerate(xs))


def trimmed(name: str, source: str, y: str, xs: list[str], limit: float) -> str:
    """Rows of the source whose residual in the fit on all rows stays within the limit; the fit is ``name_all``."""
    return f"""{normal_equations(name + "_eq", source, y, xs)},
{eliminated(name + "_all", name + "_eq", len(xs))},
{name} AS (SELECT s.* FROM {source} s, {name}_all WHERE abs({y} - ({score("b", xs)})) <= {limit})"""


def selection(source: str, y: str, inputs: list[str], controls: list[str], negative: bool = True) -> str:
    """Fits on ever fewer inputs: one elimination per step, unrolled."""
    xs = [*inputs, *controls]
    k = len(xs)
    sign = "<" if negative else ">"
    parts = [normal_equations("sel_eq", source, y, xs), f"use0 AS (SELECT [{', '.join(['true'] * k)}] AS use)"]
    for s in range(len(inputs) + 1):
        parts.append(f"masked{s} AS (SELECT {masked('use', k)} AS m FROM sel_eq, use{s})")
        parts.append(eliminated(f"step{s}", f"masked{s}", k))
        # a list position without a name beyond the inputs is a control
        stays = f"use[i + 1] AND (i >= {len(inputs)} OR b[i + 2] {sign} 0)"
        parts.append(f"use{s + 1} AS (SELECT list_transform(range({k}), lambda i: {stays}) AS use FROM use{s}, step{s})")
    last = len(inputs)
    dropped = " ".join(f"WHEN NOT u{s}.use[i + 1] THEN {s}" for s in range(1, last + 1))
    tables = ", ".join(f"use{s} u{s}" for s in range(1, last + 1))
    named = ", ".join(f"'{x}'" for x in xs)
    return (
        ",\n".join(parts),
        f"""SELECT ([{named}])[i + 1] AS variable, i < {len(inputs)} AS is_input, {rnd('f.b[i + 2]', 6)} AS first_estimate,
  {rnd(f'CASE WHEN u{last}.use[i + 1] THEN e.b[i + 2] END', 6)} AS estimate, CAST(CASE {dropped} ELSE 0 END AS INTEGER) AS dropped_at
FROM range({k}) r(i), step0 f, step{last} e, {tables}""",
    )


def components(source: str, cols: list[str], keep: float = 0.8, sweeps: int = 12, rounds: int = 40) -> str:
    """Correlations, Jacobi rotations, cut-off, loadings, varimax: ``WITH RECURSIVE`` parts and the final select."""
    k = len(cols)
    pairs = [(p, q) for p in range(k) for q in range(p + 1, k)]
    corr = ", ".join("1.0::DOUBLE" if a == b else f"corr({a}, {b})" for a in cols for b in cols)
    unit = ", ".join("1.0::DOUBLE" if i == j else "0.0::DOUBLE" for i in range(k) for j in range(k))
    # rows and columns count from 0, list positions from 1
    column = f"CASE x % {k} WHEN p THEN c * {{0}}[x + 1] - s * {{0}}[x - p + q + 1] WHEN q THEN s * {{0}}[x - q + p + 1] + c * {{0}}[x + 1] ELSE {{0}}[x + 1] END"
    row = f"CASE x // {k} WHEN p THEN c * w[x + 1] - s * w[x + (q - p) * {k} + 1] WHEN q THEN s * w[x - (q - p) * {k} + 1] + c * w[x + 1] ELSE w[x + 1] END"
    cells = f"range({k * k})"
    turn = "CASE WHEN o = 0 THEN 0.0 ELSE (CASE WHEN h < 0 THEN -1 ELSE 1 END) / (abs(h) + sqrt(h * h + 1)) END"
    vsum = lambda e: f"list_sum(list_transform(range({k}), lambda e: {e}))"
    u, v = "(x[e * n + i + 1] ** 2 - x[e * n + j + 1] ** 2)", "(2 * x[e * n + i + 1] * x[e * n + j + 1])"
    num = f"2 * {vsum(f'{u} * {v}')} - 2 * {vsum(u)} * {vsum(v)} / {k}"
    den = f"{vsum(f'{u} ** 2 - {v} ** 2')} - ({vsum(u)} ** 2 - {vsum(v)} ** 2) / {k}"
    rotated = "CASE g % n WHEN i THEN cos(f) * x[g + 1] + sin(f) * x[g - i + j + 1] WHEN j THEN cos(f) * x[g + 1] - sin(f) * x[g - j + i + 1] ELSE x[g + 1] END"
    upright = lambda m: f"CASE WHEN list_sum(list_transform(range({k}), lambda e: {m}[e * n + g % n + 1])) < 0 THEN -1 ELSE 1 END"
    parts = f"""pairs AS (SELECT [{", ".join(f"{{'p': {p}, 'q': {q}}}" for p, q in pairs)}] AS pairs),
jacobi AS (
  SELECT 0 AS t, [{corr}] AS a, [{unit}] AS v FROM {source}
  UNION ALL
  SELECT t + 1, list_transform({cells}, lambda x: {row}), nv FROM (
    SELECT t, p, q, c, s, list_transform({cells}, lambda x: {column.format("a")}) AS w, list_transform({cells}, lambda x: {column.format("v")}) AS nv FROM (
      SELECT *, 1 / sqrt(tan * tan + 1) AS c, tan / sqrt(tan * tan + 1) AS s FROM (
        SELECT *, {turn} AS tan FROM (
          SELECT *, a[p * {k} + q + 1] AS o, (a[q * {k} + q + 1] - a[p * {k} + p + 1]) / (2 * nullif(a[p * {k} + q + 1], 0)) AS h FROM (
            SELECT t, a, v, pairs[t % {len(pairs)} + 1].p AS p, pairs[t % {len(pairs)} + 1].q AS q FROM jacobi, pairs WHERE t < {sweeps * len(pairs)})))))),
eig AS (SELECT v, list_reverse_sort(list_transform(range({k}), lambda i: {{'val': a[i * {k + 1} + 1], 'at': -i}})) AS o FROM jacobi WHERE t = {sweeps * len(pairs)}),
shares AS (SELECT *, list_transform(range({k}), lambda j: list_sum(list_transform(o[1:j + 1], lambda r: r.val)) / {k}) AS share FROM eig),
cut AS (SELECT *, list_position(list_transform(share, lambda s: round(s, 2) >= {keep}), true) AS n FROM shares),
raw AS (SELECT *, list_transform(range({k} * n), lambda g: v[(g // n) * {k} - o[g % n + 1].at + 1] * sqrt(greatest(o[g % n + 1].val, 0))) AS l0 FROM cut),
loaded AS (SELECT *, list_transform(range({k} * n), lambda g: l0[g + 1] * {upright("l0")}) AS l FROM raw),
lengths AS (SELECT *, list_transform(range({k}), lambda i: sqrt(list_sum(list_transform(range(n), lambda j: l[i * n + j + 1] ** 2)))) AS len FROM loaded),
planes AS (SELECT n, list(struct_pack(i := i, j := j) ORDER BY i, j) AS planes FROM lengths, range({k}) r(i), range({k}) z(j) WHERE i < j AND j < n GROUP BY n),
turns AS (
  SELECT 0 AS t, n, list_transform(range({k} * n), lambda g: l[g + 1] / CASE WHEN len[g // n + 1] = 0 THEN 1 ELSE len[g // n + 1] END) AS x FROM lengths
  UNION ALL
  SELECT t + 1, n, list_transform(range({k} * n), lambda g: {rotated}) FROM (
    SELECT *, atan2({num}, {den}) / 4 AS f FROM (
      SELECT t, y.n, x, planes[t % len(planes) + 1].i AS i, planes[t % len(planes) + 1].j AS j FROM turns y JOIN planes ON y.n = planes.n WHERE t < {rounds} * len(planes)))),
final AS (SELECT lengths.*, list_transform(range({k} * lengths.n), lambda g: x[g + 1] * len[g // lengths.n + 1]) AS r0 FROM lengths, (SELECT x FROM turns ORDER BY t DESC LIMIT 1))"""
    named = ", ".join(f"'{c}'" for c in cols)
    return (
        parts,
        f"""SELECT ([{named}])[g // n + 1] AS variable, CAST(g % n + 1 AS INTEGER) AS component, {rnd('l[g + 1]', 5)} AS loading,
  {rnd(f'r0[g + 1] * {upright("r0")}', 5)} AS rotated, {rnd('o[g % n + 1].val', 5)} AS eigenvalue, {rnd('share[g % n + 1]', 5)} AS cum_share
FROM (SELECT *, unnest(range({k} * n)) AS g FROM final)""",
    )


def newton(points: str, steps: int = 30) -> str:
    """Logistic curve through ``points`` (x, y) by Newton steps from zero: ``b0, b1`` in ``newton``."""
    mu = "(1 / (1 + exp(-(b0 + b1 * r.x))))"
    s = lambda e: f"list_sum(list_transform(pts, lambda r: {e}))"
    return f"""pts AS (SELECT list(struct_pack(x := x, y := y)) AS pts FROM {points}),
newton AS (
  SELECT 0 AS t, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1
  UNION ALL
  SELECT t + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT t, b0, b1, {s(f'r.y - {mu}')} AS g0, {s(f'(r.y - {mu}) * r.x')} AS g1, {s(f'{mu} * (1 - {mu})')} AS h00,
      {s(f'{mu} * (1 - {mu}) * r.x')} AS h01, {s(f'{mu} * (1 - {mu}) * r.x * r.x')} AS h11 FROM newton, pts WHERE t < {steps}))"""
