"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`. `run` writes each stage's rows as Parquet into the shared
checkpoint folder and rereads them as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redline.llm import bpe, mixing, pii, rules, simhash
from redline.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id."""
    return simhash.keep(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind in brackets."""
    return pii.scrub(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is emitted as often as its source's rate and its draw say."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row."""
    return bpe.encode_documents(docs, *bpe.public_vocabulary(), with_ids=True)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("pii", personal_data),
          ("mix_sources", mix_sources), ("bpe", encode)]

#: SQL can express neither the learned list nor the covering search; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
