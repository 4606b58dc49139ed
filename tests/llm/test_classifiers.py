"""Language and toxicity models on held-out rows, fingerprints against exact similarity."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs_of  # noqa: F401

from fieldledger.llm import folds, langid, toxicity, weighted

SYLLABLES = {"aa": "ta ri no se la mo".split(), "bb": "sch ung ber ein kei auf".split(), "cc": "eau oux ment tion ille ais".split()}
BAD = ["vekrud", "sklonz", "gnarfic"]


def word(rnd, lang):
    return "".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3)))


def corpus(seed, n=900):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        w = [word(rnd, lang) for _ in range(rnd.randint(20, 120))]
        toxic = int(rnd.random() < 0.3)
        if toxic:
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(BAD)
        rows.append((i, " ".join(w), lang, toxic))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id bigint, quality int, toxic int")
    return rows, docs, labels


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = {r.id: r.f for r in spark.range(50).select("id", folds.fold("id").alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}


def test_languages_of_held_out_rows(labelled):
    rows, docs, _ = labelled
    model = langid.train(docs)
    assert (model.weights == 0).mean() > 0.5
    out = {r.doc_id: r for r in langid.languages(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([out[r[0]].lang_pred == r[2] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in out.values())


def test_held_out_labels_are_not_read(labelled):
    _, docs, labels = labelled
    other = docs.withColumn("lang", F.when(folds.fold("doc_id") == 1, F.lit("zz")).otherwise(F.col("lang")))
    a, b = langid.train(docs), langid.train(other)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)
    flipped = labels.withColumn("toxic", F.when(folds.fold("doc_id") == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels).toxic == toxicity.train(docs, flipped).toxic


def test_no_letter_is_und(labelled):
    model = langid.train(labelled[1])
    assert [model.predict(t)[0] for t in ("", "123 !?", "\n")] == ["und"] * 3
    assert model.predict("schungber")[0] == "bb"


def test_frequencies_cover_all_training_rows(labelled):
    rows, docs, _ = labelled
    n, total = langid.document_frequencies(docs.filter(folds.fold("doc_id") != 1), F.col("text"))
    plain = [langid.slot_counts(r[1]) > 0 for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert total == len(plain) and np.array_equal(n, np.sum(plain, axis=0))


def test_stretches_give_the_counts_of_the_whole(monkeypatch):
    text = "Stone river, é漢字 " * 40
    whole = langid.slot_counts(text)
    monkeypatch.setattr(langid, "STRETCH", 17)
    assert np.array_equal(langid.slot_counts(text), whole)


def test_temperature_recovers_scale():
    rnd = np.random.default_rng(1)
    margins = rnd.normal(size=(4000, 3)) * 2
    y = np.array([rnd.choice(3, p=langid.softmax(m)) for m in margins])
    assert abs(langid.temperature(3 * margins, y) - 3) < 0.3


def test_toxicity_of_held_out_rows(labelled):
    rows, docs, labels = labelled
    out = {r.doc_id: r.score for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    hit = np.array([out[r[0]] >= toxicity.AT for r in held])
    y = np.array([r[3] for r in held], bool)
    assert (hit & y).sum() / y.sum() > 0.9 and (hit & ~y).sum() / (~y).sum() < 0.05


def test_sample_is_bounded(labelled):
    _, docs, labels = labelled
    ids, counts = folds.sampled_ids(labels, "doc_id", "toxic", 50)
    n = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(20 < n[c] < 90 for c in (0, 1)) and sum(counts.values()) > 500
    texts = folds.sampled_texts(docs.join(ids, "doc_id"), 3000)
    assert 0 < sum(len(t) for t, _ in texts) <= 3000


@pytest.mark.parametrize("rare_size", [10, 900])
def test_rare_classes_keep_their_texts(spark, rare_size):
    rows = [(i, f"{i:05d}" * 20, "often", i / 1e4) for i in range(300)]
    rows += [(1000 + i, "r" * rare_size, f"rare{i}", 0.9 + i / 100) for i in range(3)] + [(2000, "x" * 2900, "often", 0.0)]
    sample = spark.createDataFrame(rows, "doc_id bigint, text string, label string, place double")
    texts = folds.sampled_texts(sample, 3000)
    assert [t for t, label in texts if label == "often"] == [r[1] for r in rows[: (3000 - 3 * rare_size) // 100]]
    assert sorted(label for _, label in texts if label != "often") == ["rare0", "rare1", "rare2"]
    assert len(folds.sampled_texts(sample, 1 << 20)) == len(rows)


def test_bytes_are_dealt_by_class():
    assert folds.fair_choice({"a": [6, 6, 1, 6], "b": [2, 2], "c": [50], "d": [9]}, 24) == {"a": [0, 2], "b": [0, 1], "c": [], "d": [0]}
    assert folds.fair_choice({}, 9) == {}


def exact(sampler, a, b):
    x, y = (dict(zip(*(v.tolist() for v in sampler.terms(t)), strict=True)) for t in (a, b))
    keys = set(x) | set(y)
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def test_collision_rate_is_generalised_jaccard():
    rnd = random.Random(4)
    sampler = weighted.Sampler(words=1, samples=256)
    gaps = []
    for _ in range(40):
        a = " ".join(rnd.choice("abcdefghijkl") * rnd.randint(1, 2) for _ in range(60))
        b = a[: len(a) // 2] + " " + " ".join(rnd.choice("abcdefghijkl") for _ in range(30))
        gaps.append(weighted.likeness(sampler.signature(a), sampler.signature(b)) - exact(sampler, a, b))
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.05


def test_collision_rate_of_long_texts_with_repeated_terms():
    sampler = weighted.Sampler(words=1, samples=256)
    common = [f"c{i}" for i in range(110_000)]
    a, b = (" ".join(common + [f"{side}{i}" for i in range(11_000)] * 5) for side in "ab")
    assert exact(sampler, a, b) == 0.5
    assert abs(weighted.likeness(sampler.signature(a), sampler.signature(b)) - 0.5) < 0.1


def test_repeats_of_all_terms_thin_the_likeness():
    sampler = weighted.Sampler(words=1, samples=1024)
    once = " ".join(f"t{i}" for i in range(50))
    for x, y in ((1, 2), (2, 3), (3, 7)):
        a, b = (" ".join([once] * n) for n in (x, y))
        assert abs(weighted.likeness(sampler.signature(a), sampler.signature(b)) - x / y) < 0.06


def test_fingerprints_beside_the_next_document(spark, docs_of):
    rnd = random.Random(6)
    rows = [(i * 7, " ".join(word(rnd, "aa") for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    out = {r.doc_id: r for r in weighted.fingerprint_pairs(docs_of(rows)).collect()}
    sampler, order = weighted.Sampler(), sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert out[i].fingerprint == weighted.hex_of(sampler.signature(t))
        assert out[i].near_next == weighted.likeness(sampler.signature(t), sampler.signature(following))
        assert out[i].near_edited == weighted.likeness(sampler.signature(t), sampler.signature(changed))


def test_one_document_follows_itself(docs_of):
    (row,) = weighted.fingerprint_pairs(docs_of([(3, "ab cd ef gh")])).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"ab cd ab cd").hexdigest()
