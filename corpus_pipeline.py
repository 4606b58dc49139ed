"""From a table of documents to token ids: five stages, each written as Parquet and read by the next.

1. language ID: documents without a letter, or whose language is too uncertain, go;
2. SimHash near-dedup: of each group of near-duplicates the document with the smallest id stays;
3. benchmark decontamination: documents with a twentieth or more of their words in benchmark passages go;
4. secret scan: secrets are masked in the text, and ``n_chars`` counted anew; no document goes;
5. BPE: the texts are encoded, and decoded again for the digest of what the ids stand for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm import bpe, decontaminate, langid, secretscan, simhash
from fieldledger.llm.registry import DocQuery, table
from fieldledger.operators.lineage import shared_folder

#: A language is taken as recognised from this calibrated probability on.
LEAST_LANGUAGE_SCORE = 0.35
# SQL has no multinomial regression, XXH64 or merge lists: the stages are tested against plain versions instead.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.kept_languages(docs, langid.train(docs), least=LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secretscan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = [F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string")]
    return bpe.coded_digests(docs, keep, "doc_id bigint, lang string, source string", with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_coding", bpe_coding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage but the last returns is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERY = DocQuery("pipeline", run, ORACLE_SQL)
