"""Vector codes against plain rounds over all distances, and the bounds themselves."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldledger.llm import vectorcodes as vc

DDL = "vec_id bigint, embedding array<float>, label int, code string, part int, near binary"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """``(vec_id, label, code, error)`` and codebooks by computing every distance."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = {k: [math.floor(scale * float(np.float32(x))) for x in v] for k, (_, v, _) in enumerate(kept)}
    first = sorted((k for k, r in enumerate(kept) if r[0] is not None), key=lambda k: (kept[k][0], [float(np.float32(x)) for x in kept[k][1]]))[:entries]
    width = len(q[first[0]]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(q[k], p) for k in first] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return {k: [min(range(len(books[p])), key=lambda j: (distance(cut(v, p), books[p][j]), j)) for p in range(parts)] for k, v in q.items()}

    for _ in range(rounds):
        near = assigned()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut(q[k], p) for k in q if near[k][p] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    near = assigned()
    out = []
    for k, (i, _, y) in enumerate(kept):
        error = sum(distance(cut(q[k], p), books[p][near[k][p]]) for p in range(parts))
        out.append((i, y, "".join(f"{j:02x}" for j in near[k]), error))
    return sorted(out, key=repr), books


def frame(spark, rows):
    full = [(i, v, y, "x", 1, None) for i, v, y in rows]
    return spark.createDataFrame(full, DDL).repartition(3)


def vectors(n, dim, seed, spread=0.2):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    return [[float(x) for x in (centres[k % 12] + spread * rnd.normal(size=dim)).astype(np.float32)] for k in range(n)]


def test_codes_are_those_of_all_distances(spark):
    vs = vectors(400, 16, 3)
    rows = [(i * 7 % 401, v, i % 5 or None) for i, v in enumerate(vs)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [None] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] * 16, 1)]
    rows += [(None, vs[5], 2), (3, vs[9], None), (3, vs[9], None)]
    want, books = plain([r for r in rows if r[0] != 1001], entries=32)
    coded, got_books = vc.vector_codes(frame(spark, rows), entries=32, listed=6)
    out = coded.collect()
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in out if r.vec_id != 1001), key=repr) == want
    assert got_books.tolist() == books
    # an empty vector has no parts
    assert [(r.code, r.error) for r in out if r.vec_id == 1001] == [(None, None)]
    sums = {}
    for _, y, _, e in want:
        sums[y] = sums.get(y, 0) + e
    assert {r.label: r.label_error for r in vc.with_label_error(coded).collect() if r.vec_id != 1001} == sums


def test_large_components_are_compared_as_integers(spark):
    rows = [(i, [x * 50_000 for x in v], None) for i, v in enumerate(vectors(60, 8, 4))]
    want, books = plain(rows, entries=10)
    coded, got = vc.vector_codes(frame(spark, rows), entries=10)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in coded.collect()), key=repr) == want and got.tolist() == books


def test_equal_vectors_and_few_rows(spark):
    rows = [(i, [0.5, -0.25, 0.125, 1.0], 1) for i in range(9)]
    coded, books = vc.vector_codes(frame(spark, rows))
    # unused entries stay: all nine are equal, ties go to the first
    assert {(r.code, r.error) for r in coded.collect()} == {("00000000", 0)}
    assert books.shape == (4, 9, 1) and (books[:, :, 0] == [[512], [-256], [128], [1024]]).all()


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(1, None, 1)], [(None, [1.0, 2.0, 3.0, 4.0], 1)]):
        coded, books = vc.vector_codes(frame(spark, rows))
        out = vc.with_label_error(coded)
        assert [(r.code, r.error) for r in out.collect()] == [(None, None)] * sum(r[1] is not None for r in rows)
        assert books.size == 0


def test_sizes_that_cannot_be_cut_or_kept_raise(spark):
    with pytest.raises(ValueError):
        vc.vector_codes(frame(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(ValueError):
        vc.vector_codes(frame(spark, [(1, [1.0] * 4, 1)]), entries=257)


def test_most_parts_keep_their_code_without_all_distances(spark):
    rnd = np.random.default_rng(8)
    centres = rnd.integers(-900, 900, size=(24, 8))
    q = centres[rnd.integers(0, 24, 3000)] + rnd.integers(-60, 60, size=(3000, 8))
    book = q[:32].copy()
    known = vc.Bounds.fresh(q, book, 8)
    counts = []
    for _ in range(4):
        code = known.near[:, 0]
        new = np.array([q[code == j].sum(0) // max(1, (code == j).sum()) if (code == j).any() else book[j] for j in range(32)])
        tally = np.zeros(36, np.int64)
        known.move(np.sqrt(((new - book) ** 2).sum(1)) * (1 + vc.SLACK))
        known.update(q, new, tally)
        book = new
        assert tally[:4].sum() == len(q)
        assert (known.near[:, 0] == vc.squared(q, book).argmin(axis=1)).all()
        counts.append(tally[:4].tolist())
    assert counts[-1][0] > 1500 and counts[-1][3] < 300


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 12), st.integers(1, 6))
def test_bounds_stay_bounds(seed, k, b):
    rnd = np.random.default_rng(seed)
    q, book = rnd.integers(-9, 9, size=(40, 3)), rnd.integers(-9, 9, size=(k, 3))
    known = vc.Bounds.fresh(q, book, b)
    for _ in range(3):
        new = book + rnd.integers(-2, 3, size=book.shape)
        known.cut(max(1, b - 1))
        known.move(np.sqrt(((new - book) ** 2).sum(1)) * (1 + vc.SLACK))
        true = np.sqrt(vc.squared(q, new))
        listed = np.take_along_axis(true, known.near.astype(np.int64), 1)
        assert (known.low[:, 0] >= listed[:, 0]).all() and (known.low[:, 1:] <= listed[:, 1:]).all()
        rest = true.copy()
        np.put_along_axis(rest, known.near.astype(np.int64), np.inf, 1)
        assert (known.outer <= rest.min(1)).all()
        book = new
        known.update(q, book, np.zeros(4 + k, np.int64))
        assert (known.near[:, 0] == np.lexsort((np.broadcast_to(np.arange(k), (40, k)), vc.squared(q, book)))[:, 0]).all()


def test_listed_entries_shrink_to_the_deepest_used():
    tally = np.zeros(4 + 256, np.int64)
    assert vc.deepest(tally, 16) == vc.LEAST
    tally[4 + 6] = 1
    assert vc.deepest(tally, 16) == 8 and vc.deepest(tally, 5) == 5


def test_states_are_removed_once_they_are_superseded(spark):
    import os

    folder = vc.shared_folder(spark).removeprefix("file:")
    before = {n for n in os.listdir(folder) if n.startswith("codes-")}
    vc.vector_codes(frame(spark, [(i, v, 1) for i, v in enumerate(vectors(30, 4, 1))]))
    assert {n for n in os.listdir(folder) if n.startswith("codes-")} == before
