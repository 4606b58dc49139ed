"""Word counts of the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldledger.operators.text import LATEX_STRIP, MARKDOWN_STRIP, count_document_words
from fieldledger.plans.registry import query
from fieldledger.plans.views import table


def _sql_strip(text: str, rules: list[tuple[str, str, str | None]]) -> str:
    for pattern, replacement, _ in rules:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


def _sql_words(rules: list[tuple[str, str, str | None]]) -> str:
    return f"len(regexp_extract_all({_sql_strip('text', rules)}, '\\S+'))"


COUNTS_SQL = f"""
counts AS (
  SELECT doc_id, source, {_sql_words(MARKDOWN_STRIP)} AS markdown_words, {_sql_words(LATEX_STRIP)} AS latex_words
  FROM documents)"""


@query(
    "document_word_count",
    f"""WITH {COUNTS_SQL} SELECT doc_id, CAST(markdown_words AS BIGINT) AS markdown_words,
        CAST(latex_words AS BIGINT) AS latex_words FROM counts""",
)
def document_word_count(spark, d):
    counted = count_document_words(table(spark, d, "documents").select("doc_id", "text"))
    return counted.select(
        "doc_id", F.col("markdown_words").cast("long").alias("markdown_words"),
        F.col("latex_words").cast("long").alias("latex_words"),
    )


@query(
    "source_word_totals",
    f"""WITH {COUNTS_SQL} SELECT source, CAST(count(*) AS BIGINT) AS n_docs,
        CAST(sum(markdown_words) AS BIGINT) AS markdown_words, CAST(sum(latex_words) AS BIGINT) AS latex_words
        FROM counts GROUP BY source""",
)
def source_word_totals(spark, d):
    counted = count_document_words(table(spark, d, "documents").select("source", "text"))
    return counted.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.col("markdown_words").cast("long")).alias("markdown_words"),
        F.sum(F.col("latex_words").cast("long")).alias("latex_words"),
    )
