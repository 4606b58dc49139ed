"""Every operator and stage on nulls, empty tables, repeated rows, long texts and clashing column names."""

import pytest

from llm_fixtures import docs_of, edge_rows  # noqa: F401

import corpus_pipeline
from fieldledger.llm import bpe, count, decontaminate, langid, pii, repeats, secretscan, simhash, toxicity, weighted

BENCH = "item_id bigint, text string, spans int"


def operators(spark):
    bench = spark.createDataFrame([(1, "same words here", 0), (2, None, 0), (None, "x", 0), (3, "", 0)], BENCH)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    return {
        "weighted": weighted.fingerprint_pairs,
        "bpe": bpe.coded_digests,
        "langid": lambda d: langid.languages(d, langid.train(d)),
        "repeats": repeats.without_repeats,
        "repeats_first": lambda d: repeats.without_repeats(d, keep_first=True),
        "toxicity": lambda d: toxicity.toxicity(d, toxicity.train(d, labels)),
        "pii": pii.pii_spans,
        "decontaminate": lambda d: decontaminate.benchmark_hits(d, bench),
        "decontaminate_empty": lambda d: decontaminate.benchmark_hits(d, bench.limit(0)),
        "secretscan": secretscan.secret_spans,
        "count": count.token_counts,
        "simhash": simhash.near_duplicates,
    }


NAMES = ["weighted", "bpe", "langid", "repeats", "repeats_first", "toxicity", "pii", "decontaminate", "decontaminate_empty", "secretscan", "count", "simhash"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_kept_one_for_one(spark, docs_of, edge_rows, name):
    out = operators(spark)[name](docs_of(edge_rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, _ in edge_rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs_of, name):
    assert operators(spark)[name](docs_of([])).collect() == []


def test_equal_rows_have_equal_results(spark, docs_of, edge_rows):
    for name in ("bpe", "pii", "count", "simhash", "repeats"):
        rows = [r for r in operators(spark)[name](docs_of(edge_rows)).collect() if r.doc_id == 5]
        assert len(rows) == 2 and rows[0] == rows[1]


def test_stages_on_edge_cases(spark, docs_of, edge_rows, tmp_path):
    spark.createDataFrame([(1, "same words here", 0)], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (edge_rows, []):
        docs = docs_of(rows)
        for k, (_name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            found = out.collect()
            if k < 4:
                assert out.columns == docs.columns
            if not rows:
                assert found == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "bpe_coding"]
