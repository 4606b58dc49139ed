"""Ranked search against scores computed plainly, document by document."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import docs_of, edge_rows  # noqa: F401

from fieldledger.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, top=20):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n = sum(1 for d in held if d[2])
    total = sum(d[2] for d in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in asked.items():
        scores = []
        for i, tf, size in held:
            s = 0
            for t, times in query.items():
                if tf[t]:
                    m = 100 - 25 + 25 * size * n // total
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    s += times * w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
            if s:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    items = spark.createDataFrame(items, "item_id bigint, text string, rank int, k string" if items and len(items[0]) == 4 else "item_id bigint, text string")
    return sorted((tuple(r) for r in ranked.ranked_search(docs, items, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = []
    for i in range(700):
        docs.append((i, " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 5, 40, 300])))))
    docs += [(1000 + i, docs[3][1]) for i in range(40)]  # copies tie
    items = [(j, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 30])))) for j in range(25)]
    return docs, items


def test_against_plain_scores(spark, docs_of, corpus):  # noqa: F811
    docs, items = corpus
    assert found(spark, docs_of(docs), items) == plain(docs, items)


def test_small_blocks_and_item_groups_change_nothing(spark, docs_of, corpus, monkeypatch):  # noqa: F811
    docs, items = corpus
    want = plain(docs, items)
    assert found(spark, docs_of(docs), items, max_item_bytes=700) == want
    search = ranked.Search([(j, dict(Counter(t.encode() for t in terms(x)))) for j, x in items], *stats(docs, items))
    for block in (1, 7, 64):
        monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
        monkeypatch.setattr(ranked, "FIRST_READ", 1 + block // 3)
        search.best = [[] for _ in items]
        for i, t in docs:
            search.add(i, t)
        got = sorted(((items[k][0], i, s) for k, i, s in search.rows()), key=repr)
        assert got == sorted(((a, i, s) for a, _, i, s in want), key=repr)


def stats(docs, items):
    wanted = {t for _, x in items for t in terms(x)}
    df = Counter(t for _, x in docs for t in set(terms(x)) & wanted)
    return {t.encode(): n for t, n in df.items()}, sum(1 for _, x in docs if terms(x)), sum(len(terms(x)) for _, x in docs)


def test_reading_stops_before_the_lists_end():
    n = 5000
    ids, lengths = list(range(n)), [10] * n
    # one rare term decides; the frequent ones need not be read to their ends
    postings = {0: (list(range(n)), [1] * n), 1: (list(range(30)), [9 - i % 3 for i in range(30)])}

    class Counted(ranked.Block):
        pass

    block = Counted(ids, lengths, postings, ranked.np.array([1, 9000]), n, 10 * n)
    touched = []

    class Listed(tuple):
        pass

    d, impact = block.lists[0]

    class Spy(ranked.np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                touched.append(min(key.stop, len(self)))
            return super().__getitem__(key)

    block.lists[0] = d.view(Spy), impact
    got = sorted(block.search({0: 1, 1: 1}, 0), key=lambda x: (-x[0], x[1]))[:20]
    assert [a for _, a in got][:10] == list(range(0, 30, 3))
    assert max(touched) < n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=12), min_size=1, max_size=40), st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=6), st.integers(1, 5))
def test_blocks_agree_with_plain_scores(documents, query, top):
    docs = [(i, " ".join(w)) for i, w in enumerate(documents)]
    items = [(0, " ".join(query))]
    df, n, total = stats(docs, items)
    search = ranked.Search([(0, dict(Counter(t.encode() for t in query)))], df, n, total, top)
    for i, t in docs:
        search.add(i, t)
    assert [(0, k, i, s) for k, (_, i, s) in enumerate(search.rows(), 1)] == [(a, r, i, s) for a, r, i, s in sorted(plain(docs, items, top), key=lambda x: x[1])]


def test_edges(spark, docs_of, edge_rows):  # noqa: F811
    items = [(1, "SAME words", 0, "x"), (1, "words stone", 0, "x"), (2, None, 0, "x"), (3, "...", 0, "x"), (None, "river é漢字", 0, "x"), (4, "nowhere", 0, "x")]
    got = found(spark, docs_of(edge_rows), items)
    assert got == plain(edge_rows, [(i, t) for i, t, *_ in items])
    assert {r[0] for r in got} == {1, None}
    assert found(spark, docs_of([]), items) == []
    assert found(spark, docs_of(edge_rows), []) == []
