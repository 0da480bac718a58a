"""From raw documents to token ids: quality rules, near-dedup, secret redaction, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. The first four return the columns of documents; the last returns doc_id,
n_tokens and ids. A document with a secret stays, with the secret's characters
replaced by a mark. The mix repeats a document's row for each whole pass over
its source and cuts the text of the one document where a source's budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, near_dedup, quality, secret_scan
from tidemark.llm.common import read_table, small_batches, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    df = secret_scan.redact(docs)
    return df.withColumn("n_chars", secret_scan.length_of(df, "text"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark, 500)  # ids and decoded texts go back, several times what came
    return bpe.encode(docs).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: SQL cannot express near-duplicates by sampling or the tokenizer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
