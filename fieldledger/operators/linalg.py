"""Small dense matrices as flat arrays, row after row, treated by folds inside the JVM.

The texts are SQL expressions over columns; ``d`` or ``k``, the number of columns of a square matrix, is known when
the plan is built. Work depends on it alone, never on the rows that the matrix was summed over.
"""

from __future__ import annotations

#: A column whose pivot has lost this share of its own sum of squares repeats earlier ones.
TOLERANCE = 1e-9
#: Sweeps over all pairs: the off-diagonal elements fall quadratically, the rotations to simple structure linearly.
JACOBI_SWEEPS, VARIMAX_SWEEPS = 12, 40


def swept(g: str, d: int, use: str) -> str:
    """Gram matrix swept on its first ``d - 1`` columns where the array ``use`` is true.

    A struct: ``m``, which then holds the inverse of the swept block, the coefficients in its last column and the
    residual sum of squares in its last element; and ``kept``, the swept columns. Columns that repeat earlier ones
    are passed over.
    """
    i, j, pivot = f"(x div {d})", f"(x % {d})", f"s.m[p * {d} + p]"
    element = (
        f"CASE WHEN {i} = p AND {j} = p THEN 1 / {pivot} WHEN {i} = p THEN s.m[x] / {pivot} "
        f"WHEN {j} = p THEN -s.m[x] / {pivot} ELSE s.m[x] - s.m[{i} * {d} + p] * s.m[p * {d} + {j}] / {pivot} END"
    )
    step = f"named_struct('m', transform(sequence(0, {d * d - 1}), x -> {element}), 'kept', concat(s.kept, array(p)))"
    worth = f"{use}[p] AND {pivot} > {TOLERANCE!r}D * {g}[p * {d} + p]"
    start = f"named_struct('m', {g}, 'kept', CAST(array() AS ARRAY<INT>))"
    if d == 1:
        return start
    return f"aggregate(sequence(0, {d - 2}), {start}, (s, p) -> CASE WHEN {worth} THEN {step} ELSE s END)"


def dot(k: int, term: str) -> str:
    """Sum of ``term`` over i from 0 to k - 1."""
    return f"aggregate(sequence(0, {k - 1}), 0D, (t, i) -> t + {term})"


def eigen(a: str, k: int) -> str:
    """Eigenvalues and vectors of a symmetric matrix by cyclic Jacobi rotations.

    A struct of flat matrices: ``a``, whose diagonal holds the values, and ``v``, whose columns are the vectors.
    """
    unit = f"transform(sequence(0, {k * k - 1}), x -> CASE WHEN x % {k + 1} = 0 THEN 1D ELSE 0D END)"
    start = f"named_struct('a', {a}, 'v', {unit})"
    pairs = [(p, q) for p in range(k) for q in range(p + 1, k)]
    if not pairs:
        return start
    listed = "array(" + ", ".join(f"named_struct('p', {p}, 'q', {q})" for p, q in pairs) + ")"
    every = f"flatten(array_repeat({listed}, {JACOBI_SWEEPS}))"

    def turned(m: str, place: str, jump: str) -> str:
        body = (
            f"CASE WHEN {place} = o.p THEN r.c * {m}[x] - r.s * {m}[x + (o.q - o.p){jump}] "
            f"WHEN {place} = o.q THEN r.s * {m}[x - (o.q - o.p){jump}] + r.c * {m}[x] ELSE {m}[x] END"
        )
        return f"transform(sequence(0, {k * k - 1}), x -> {body})"

    columns = lambda m: turned(m, f"x % {k}", "")
    rows = f"transform(array({columns('z.a')}), b -> {turned('b', f'x div {k}', f' * {k}')})[0]"
    off = f"z.a[o.p * {k} + o.q]"
    ratio = f"(z.a[o.q * {k} + o.q] - z.a[o.p * {k} + o.p]) / (2 * {off})"
    # tangent of the smaller angle, then its cosine and sine
    tangent = f"transform(array({ratio}), h -> CASE WHEN h < 0 THEN -1D ELSE 1D END / (abs(h) + sqrt(h * h + 1)))[0]"
    angle = f"transform(array({tangent}), t -> named_struct('c', 1 / sqrt(t * t + 1), 's', t / sqrt(t * t + 1)))[0]"
    step = f"transform(array({angle}), r -> named_struct('a', {rows}, 'v', {columns('z.v')}))[0]"
    return f"aggregate({every}, {start}, (z, o) -> CASE WHEN abs({off}) < 1e-300D THEN z ELSE {step} END)"


def varimax(x: str, k: int, n: str) -> str:
    """A k by n matrix, n an expression, rotated to simple structure by plane rotations, each by its best angle."""
    pairs = (
        f"CASE WHEN {n} > 1 THEN flatten(transform(sequence(0, {n} - 2), i -> transform(sequence(i + 1, {n} - 1), "
        "j -> named_struct('i', i, 'j', j)))) ELSE CAST(array() AS ARRAY<STRUCT<i: INT, j: INT>>) END"
    )
    u = f"(m[e * {n} + o.i] * m[e * {n} + o.i] - m[e * {n} + o.j] * m[e * {n} + o.j])"
    v = f"(2 * m[e * {n} + o.i] * m[e * {n} + o.j])"
    summed = ", ".join(f"'{name}', {value}" for name, value in (("u", "w.u + h.u"), ("v", "w.v + h.v"), ("uv", "w.uv + h.u * h.v"), ("d", "w.d + h.u * h.u - h.v * h.v")))
    pieces = f"transform(sequence(0, {k - 1}), e -> named_struct('u', {u}, 'v', {v}))"
    sums = f"aggregate({pieces}, named_struct('u', 0D, 'v', 0D, 'uv', 0D, 'd', 0D), (w, h) -> named_struct({summed}))"
    angle = f"transform(array({sums}), w -> atan2(2 * w.uv - 2 * w.u * w.v / {k}, w.d - (w.u * w.u - w.v * w.v) / {k}) / 4)[0]"
    body = (
        f"CASE WHEN x % {n} = o.i THEN cos(f) * m[x] + sin(f) * m[x - o.i + o.j] "
        f"WHEN x % {n} = o.j THEN cos(f) * m[x] - sin(f) * m[x - o.j + o.i] ELSE m[x] END"
    )
    step = f"transform(array({angle}), f -> transform(sequence(0, {k} * {n} - 1), x -> {body}))[0]"
    return f"aggregate(flatten(array_repeat({pairs}, {VARIMAX_SWEEPS})), {x}, (m, o) -> {step})"
