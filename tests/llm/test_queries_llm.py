"""The registered queries: names, columns, and the one with a SQL twin."""

import pytest
from compare import compare, duck
from conftest import SMALL

import __spark_entry__
from fieldledger.llm.registry import QUERIES

COLUMNS = {
    "op1": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3": "doc_id held_out lang_pred score",
    "op4": "doc_id n_bytes n_removed n_spans kept_sha256 has_repeats",
    "op5": "doc_id held_out score predicted",
    "op6": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9": "doc_id n_bytes n_tokens over_limit",
    "op10": "doc_id fingerprint component_id",
    "op11": "vec_id code error label_error codebooks_sha256",
    "op12": "doc_id piece start length ids_crc32 sequence_id offset",
    "op13": "item_id rank doc_id score",
}
#: Rows of a result that are not one per document.
ROWS = {"op11": ("embeddings", 1, 1), "op12": ("documents", 1, 2), "op13": ("benchmark", 1, 20)}


def test_all_queries_and_the_pipeline():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(COLUMNS)
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    df = QUERIES[name].build(spark, SMALL)
    assert df.columns == COLUMNS[name.split("_")[0]].split()
    source, least, most = ROWS.get(name.split("_")[0], ("documents", 1, 1))
    n = spark.read.parquet(f"{SMALL}/{source}.parquet").count()
    assert least * n <= df.count() <= most * n


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_sql_twin(spark, name):
    assert compare(spark, duck(SMALL), SMALL, QUERIES[name]) == ""


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 150 < len(ids) == len(set(ids)) < 200
