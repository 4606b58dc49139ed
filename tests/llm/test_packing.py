"""Packing: ids against the public library, sequences against item-by-item best fit, places without gaps."""

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_fixtures import docs_of, edge_rows  # noqa: F401

from fieldledger.llm import bpe, packing
from fieldledger.llm.wordbatch import PairTable, batch_encoder, merge_rows


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(packing.FILE))
    t.no_truncation()
    t.no_padding()
    return t


def best_fit(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(gaps, x)
        if i < len(gaps):
            gap = gaps.pop(i)
        else:
            gap, n = capacity, n + 1
        insort(gaps, gap - x)
    return n


def check_places(rows, capacity):
    held = defaultdict(list)
    for sequence, offset, length in rows:
        held[sequence].append((offset, length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(held) == list(range(len(held)))
    return len(held)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120))
def test_plan_places_every_piece_and_needs_no_more_than_best_fit(lengths):
    counts = Counter(lengths)
    runs = packing.plan(counts, 30)
    held = Counter()
    for r in runs:
        assert sum(n * c for n, c in r.parts) + r.gap == 30 and r.gap >= 0
        assert sum(c for n, c in r.parts if 3 * n > 30) <= 2
        for n, c in r.parts:
            held[n] += c * r.count
    assert held == counts
    assert sum(r.count for r in runs) <= best_fit(lengths, 30)
    places = packing.Places(runs, max(counts.values(), default=0) + 1)
    for_all = [(n, k) for n, c in counts.items() for k in range(c)]
    if for_all:
        n, k = np.array(for_all).T
        assert check_places(zip(*(x.tolist() for x in places.of(n, k)), n.tolist(), strict=True), 30) == places.sequences


def test_large_pieces_need_the_fewest_sequences():
    # 5 pairs fit although the longest goes with the shortest in most of them
    runs = packing.plan({60: 2, 55: 3, 40: 2, 45: 2, 44: 1}, 100)
    assert sum(r.count for r in runs) == 5


def test_plan_grows_with_lengths_not_with_rows():
    counts = {n: 10**9 + n for n in range(1, 2049)}
    runs = packing.plan(counts)
    total = sum(n * c for n, c in counts.items())
    assert len(runs) < 4 * 2048
    # pieces above two thirds, and of them those whose gap nothing fills, decide how much stays free
    assert sum(r.count for r in runs) < 1.001 * total / 2048


def test_a_piece_that_is_too_long_or_empty_raises():
    for n in (0, 31):
        with pytest.raises(ValueError):
            packing.plan({n: 1}, 30)


def test_pieces_are_the_ids_of_the_library(spark, docs_of, edge_rows, library):  # noqa: F811
    rows = [*edge_rows, (20, "it's <|endoftext|> here\x1c there\x1f x"), (21, "w" * 500 + " É ΑΣ Σ"), (22, "a " * 2047), (23, "b " * 2048)]
    docs = docs_of(rows)
    out = packing.pack_documents(docs, with_ids=True).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.token_ids)) for r in out)
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert got == want
    check_places([(r.sequence_id, r.offset, r.length) for r in out], 2048)
    sizes = {r.doc_id: r.length for r in out if r.piece == 0}
    assert sizes[22] == 2048 and sum(r.doc_id == 23 for r in out) == 2


def test_one_length_may_hold_all_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'one two three' AS text").repartition(7)
    out = packing.pack_documents(docs, capacity=10).collect()
    assert check_places([(r.sequence_id, r.offset, r.length) for r in out], 10) == 1500


def test_empty_table(docs_of):  # noqa: F811
    out = packing.pack_documents(docs_of([]))
    assert out.collect() == [] and out.columns[-2:] == ["sequence_id", "offset"]


def test_words_merged_in_arrays_are_those_merged_one_by_one():
    encoder = batch_encoder(packing.FILE, "")
    rnd = np.random.default_rng(5)
    letters = list("abcdehilnorstué漢")
    words = ["".join(rnd.choice(letters, rnd.integers(1, 14))) for _ in range(3000)] + ["x" * 31, "x" * 32, "x" * 33, "ab" * 200]
    assert list(encoder.words(words)) == [encoder.slow[w] for w in words]


def test_rows_of_one_symbol_and_without_merges():
    merges = bpe.MergeList({"a": 0, "b": 1}, {}, {}, "")
    symbols = np.array([[0, 1], [1, -1]], np.int32)
    assert merge_rows(symbols, PairTable(merges)).tolist() == symbols.tolist()
    assert merge_rows(symbols[:, :1], PairTable(merges)).tolist() == [[0], [1]]
