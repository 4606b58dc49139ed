"""Near-duplicates and repeated strings against brute force, with hot groups."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from llm_fixtures import docs_of  # noqa: F401

import corpus_pipeline
from fieldledger.llm import components, repeats, simhash

rnd0 = random.Random(11)
VOCAB = ["".join(rnd0.choice("abcdefghij") for _ in range(5)) for _ in range(300)]


def text(rnd, n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def near_corpus(seed=3):
    rnd = random.Random(seed)
    rows = [(i, text(rnd, rnd.randint(0, 80))) for i in range(0, 150)]
    base = text(rnd, 120).split()
    for i in range(150, 260):  # a large group of near copies of one document
        w = list(base)
        w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
        rows.append((i, " ".join(w)))
    rows += [(300 + i, rows[5][1]) for i in range(60)] + [(400, ""), (401, None)]
    return rows


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    found = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=4):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array(fps, np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(f[k + 1 :] ^ f[k]) <= radius) + k + 1:
            a, b = find(i), find(ids[int(j)])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("shard", [simhash.SHARD, 20])
def test_components_equal_brute_force(spark, docs_of, monkeypatch, shard):
    rows = near_corpus()
    links = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda n, r, b: links(n, r, b, shard))
    out = {r.doc_id: r for r in simhash.near_duplicates(docs_of(rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert all(out[i].fp & (1 << 64) - 1 == fps[i] for i in fps)
    ids = sorted(fps)
    want = plain_components(ids, [fps[i] for i in ids])
    assert {i: out[i].component_id for i in ids} == want and len(set(want.values())) < len(ids) - 100


@pytest.mark.parametrize("frontier", [1 << 20, 50])
def test_forest_links_connect_what_pairs_connect(monkeypatch, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", max(frontier, 64))
    rnd = np.random.default_rng(2)
    for _ in range(12):
        centres = rnd.integers(0, 1 << 63, 4, dtype=np.uint64)
        flips = [sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 9), replace=False)) for _ in range(300)]
        fp = np.unique(centres[rnd.integers(0, 4, 300)] ^ np.array(flips, np.uint64))
        group = np.sort(rnd.integers(0, 3, len(fp)))
        a, b = simhash.Forest(group, fp).links(4)
        got = simhash.joined(np.arange(len(fp)), a, b)
        for g in range(3):
            at = np.flatnonzero(group == g)
            want = plain_components(list(range(len(at))), fp[at].tolist())
            assert [int(x) for x in got[at]] == [int(at[want[k]]) for k in range(len(at))]
        assert len(a) < len(fp)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a bigint, b bigint").repartition(4)
    out = {r.node: r.root for r in components.components(links).collect()}
    assert out == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_rows_that_share_an_id_hold_groups_together(docs_of):
    a, b = " ".join(VOCAB[:40]), " ".join(VOCAB[100:140])
    out = simhash.near_duplicates(docs_of([(5, a), (5, b), (7, a), (9, b)])).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(5, 5), (7, 5), (9, 5)}


def test_near_dedup_stage_keeps_one_of_each_group(spark, docs_of):
    rows = near_corpus()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    assert kept == set(plain_components(ids, [fps[i] for i in ids]).values())


def repeat_corpus(length, seed=8):
    rnd = random.Random(seed)
    noise = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passage, short = noise(3 * length), noise(length - 1)
    rows = [(i, noise(rnd.randint(0, 6 * length))) for i in range(25)]
    rows += [(100 + i, noise(rnd.randint(0, length)) + passage[rnd.randint(0, length) : rnd.randint(2 * length, 3 * length)] + noise(9)) for i in range(40)]
    rows += [(200 + i, noise(5) + short + noise(5)) for i in range(4)]
    rows += [(300, "ab" * 3 * length), (301, noise(length) * 3), (302, rows[3][1]), (303, rows[3][1]), (304, "x" * 4 * length), (305, None)]
    return rows


def plain_repeats(rows, length, keep_first):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = {}
    for i in sorted(raw):
        for s in range(len(raw[i]) - length + 1):
            seen.setdefault(raw[i][s : s + length], []).append((i, s))
    out = {}
    for i, r in raw.items():
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - length + 1):
            places = seen[r[s : s + length]]
            if len(places) > 1 and not (keep_first and places[0] == (i, s)):
                gone[s : s + length] = True
        left = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out[i] = (len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("share", [repeats.SHARE, 7, 0])
@pytest.mark.parametrize("keep_first", [False, True])
def test_removed_bytes_equal_brute_force(docs_of, share, keep_first):
    length = 60
    rows = repeat_corpus(length)
    out = repeats.without_repeats(docs_of(rows), length=length, gram=16, share=share, keep_first=keep_first).collect()
    got = {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.runs), len(r.runs), r.kept_sha256) for r in out}
    assert got == plain_repeats(rows, length, keep_first)


def plain_passages(rows, words):
    """Per row the words, and how many stretches of them, that runs of so many words cover which another row holds too."""
    split = [(t or "").encode().split() for _, t in rows]
    holders = {}
    for k, w in enumerate(split):
        for s in range(len(w) - words + 1):
            holders.setdefault(tuple(w[s : s + words]), set()).add(k)
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        hit = np.zeros(len(w), int)
        for s in range(len(w) - words + 1):
            if len(holders[tuple(w[s : s + words])]) > 1:
                hit[s : s + words] = 1
        out.append((i is None, i or 0, int(hit.sum()), int((np.diff(np.r_[0, hit]) == 1).sum())))
    return sorted(out)


def passage_corpus(words, seed=21):
    rnd = random.Random(seed)
    noise = lambda n: " ".join(rnd.choice(VOCAB) for _ in range(n))
    passage = noise(3 * words).split()
    rows = [(i, noise(rnd.randint(0, 5 * words))) for i in range(20)]
    # parts of a passage, in other surroundings and with other white space
    for i in range(30):
        a = rnd.randint(0, 2 * words)
        rows.append((100 + i, noise(rnd.randint(0, words)) + rnd.choice([" ", "\n\t ", "  "]).join(["", *passage[a : a + rnd.randint(words - 1, 2 * words)], ""]) + noise(9)))
    own = noise(2 * words)
    rows += [(200, own + " " + noise(3) + " " + own), (201, noise(words) + " " + own[: len(own) // 3]), (202, "la " * 4 * words), (203, "la " * (words + 3))]
    # one document repeats what it shares in part with another
    rows += [(204, passage_end := " ".join(passage[words:]) + " " + noise(7) + " " + " ".join(passage[words - 3 :])), (205, passage_end)]
    return rows + [(300, rows[3][1]), (301, rows[3][1]), (302, rows[4][1]), (4, rows[4][1]), (None, rows[5][1]), (None, own), (None, own), (303, ""), (304, None)]


@pytest.mark.parametrize("cores", [repeats.CORES, 1])
def test_passages_that_other_documents_hold_equal_brute_force(docs_of, monkeypatch, cores):
    monkeypatch.setattr(repeats, "CORES", cores)
    rows = passage_corpus(12)
    out = repeats.without_repeats(docs_of(rows), words=12, word_gram=3).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, sum(x.end - x.start for x in r.passages), len(r.passages)) for r in out)
    assert got == plain_passages(rows, 12) and sum(r[2] > 0 for r in got) > 30


def test_passages_of_over_50_words_under_400_bytes(spark, tmp_path):
    """Planted in documents that share nothing else: too short for a removal, and told."""
    from fieldledger.llm.registry import QUERIES

    rnd = random.Random(23)
    noise = lambda n: " ".join("".join(rnd.choice("klmnopqrst") for _ in range(6)) for _ in range(n))
    passages = [text(rnd, 51) for _ in range(5)]
    rows = [(i, noise(rnd.randint(0, 200)) + " " + passages[i % 5] + " " + noise(60)) for i in range(20)]
    rows += [(100 + i, noise(rnd.randint(51, 300))) for i in range(20)]
    rows += [(200 + i, noise(60) + " " + " ".join(passages[0].split()[:50]) + " " + noise(60)) for i in range(5)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in QUERIES["op4_suffix_repeats"].build(spark, str(tmp_path)).collect()}
    assert len(passages[0]) < 400 and all(r.n_removed == 0 and not r.has_repeats for r in out.values())
    assert {i for i, r in out.items() if r.has_passages} == set(range(20))
    assert all(r.n_passage_words == (51 if i < 20 else 0) for i, r in out.items())


def test_anchors_give_every_start_once():
    powers = repeats.Powers()
    rnd = random.Random(9)
    for raw in (bytes(rnd.randrange(256) for _ in range(3000)), b"a" * 2000, b"ab" * 900, b"x" * 59, b""):
        runs = list(repeats.anchors(raw, powers, 60, 16))
        assert [s for _, lo, hi in runs for s in range(lo, hi + 1)] == list(range(max(0, len(raw) - 59)))
        assert all(lo <= p <= hi + 44 and p - lo <= 44 for p, lo, hi in runs)


def test_anchors_of_many_texts_are_those_of_each(monkeypatch):
    powers = repeats.Powers()
    rnd = random.Random(13)
    for joined in (repeats.JOINED_BYTES, 64):
        monkeypatch.setattr(repeats, "JOINED_BYTES", joined)
        for unit in (1, 8):
            for _ in range(60):
                raws = [bytes(rnd.choice(b"ab") for _ in range(unit * rnd.choice([0, 3, 30, 90]))) for _ in range(rnd.randint(0, 9))]
                want = [(k, *x) for k, r in enumerate(raws) for x in repeats.anchors(r, powers, 20, 6, unit)]
                assert list(repeats.anchors_of_all(raws, powers, 20, 6, unit)) == want


def test_offset_ranges_hold_every_start_once_and_a_core_all_its_strings_have():
    powers = repeats.Powers()
    rnd = random.Random(11)
    raw = bytes(rnd.choice(b"abc") for _ in range(2000)) + b"z" * 300
    for length, gram in ((60, 16), (60, 57), (64, 64), (400, 64)):
        for p, lo, hi in repeats.anchors(raw, powers, length, gram):
            found = list(repeats.offset_ranges(raw[lo : hi + length], length, gram, powers))
            starts = [lo + x for _, a, b, _ in found for x in range(a, b + 1)]
            assert sorted(starts) == list(range(lo, hi + 1)) and len(found) <= max(repeats.CORES + 1, length - gram + 1 if length - gram < 8 else 0)
            width = max(1, (length - gram) // repeats.CORES)
            for g, a, b, core in found:
                assert len(core) == length - width + 1
                for s in range(lo + a, lo + b + 1):
                    assert (p - s) // width == g and raw[p - width * g :].startswith(core) and s <= p - width * g <= s + width - 1


def test_no_task_gathers_a_large_group(docs_of):
    """One stretch with very many surroundings: what meets by key is one place of each class, whatever their number."""
    rnd = random.Random(12)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(30))
    noise = lambda: "".join(rnd.choice("ijklmnop ") for _ in range(60))
    rows = [(i, noise() + line + noise()) for i in range(300)]
    rows += [(1000 + i, rows[i][1][10:140]) for i in range(20)]
    out = repeats.without_repeats(docs_of(rows), length=60, gram=16, share=5).collect()
    got = {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.runs), len(r.runs), r.kept_sha256) for r in out}
    assert got == plain_repeats(rows, 60, False) and sum(v[1] > 0 for v in got.values()) == 40


def test_suffix_order_and_factors():
    rnd = random.Random(10)
    raw = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(400)) + b"abab" * 20, np.uint8)
    for length in (9, 16, 40):
        starts = np.arange(len(raw) - length + 1)
        rank = repeats.suffix_classes(raw, starts, length)
        part = [raw[s : s + length].tobytes() for s in starts]
        order = sorted(range(len(starts)), key=lambda s: part[s])
        assert all((rank[a] < rank[b]) if part[a] < part[b] else rank[a] == rank[b] for a, b in zip(order, order[1:], strict=False))
        before, after = repeats.factor_tests(rank, starts)
        assert before.tolist() == [part[s] in part[:s] for s in starts]
        assert after.tolist() == [part[s] in part[s + 1 :] for s in starts]


def test_one_row_of_each_group_stays(spark):
    ddl = "doc_id bigint, text string, spans string"
    near = "the quick brown fox jumps over the lazy dog and runs far away " * 40
    rows = [(1, "same words here", "b"), (1, "same words here", "a"), (None, "same words here", "a"), (None, "same words here", "c"), (2, "same words here", "a")]
    rows += [(7, near, "x"), (3, near + "today", "y"), (None, near, "z"), (None, "only here " * 30, "p"), (None, "only here " * 30, "p")]
    rows += [(9, "one text of nine " * 5, "q"), (9, "quite another of nine " * 6, "q"), (10, None, "n"), (11, "", "n"), (None, None, "n")]
    out = simhash.one_per_group(spark.createDataFrame(rows, ddl).repartition(4)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 1), (False, 3), (False, 9), (False, 9), (False, 10), (True, 0)]
    assert len({r.text for r in out}) == 6
    # which of the equal rows stays does not depend on their order
    again = simhash.one_per_group(spark.createDataFrame(rows[::-1], ddl).repartition(2)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, out), key=repr)


def test_a_node_with_many_neighbours_can_be_split(spark):
    from fieldledger.llm.components import with_least

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "23",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        pairs = spark.range(0, 120_000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id + 10 END AS node", "id + 200000 AS other")
        joined = with_least(pairs)
        assert joined.filter("node = 5").count() == 40_000
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stages_hold_little_of_a_large_batch():
    """10,000 rows in one batch: a stage keeps objects of one piece of it at a time."""
    import tracemalloc

    import pyarrow as pa

    from fieldledger.llm.rows import PIECE_BYTES, pieces
    from fieldledger.llm.secretscan import RULES, scanner
    from fieldledger.llm.spans import masked

    batch = pa.RecordBatch.from_pydict({"text": ["some words and a key of no secret " * 70] * 10_000})
    find = scanner(RULES)()
    tracemalloc.start()
    rows = 0
    for piece in pieces(batch):
        texts = piece.column(0).to_pylist()
        made = [masked(t, s, "x") for t, s in zip(texts, find(texts), strict=True)]
        rows += len(made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 10_000 and peak < 12 * PIECE_BYTES < batch.nbytes * 3
