"""Corpus pipeline: quality rules, toxicity, near-duplicates, benchmark passages, token ids.

Each stage works on what the one before kept and is written as Parquet before the next reads it.
All stages but the last return the columns of ``documents``; rows they reject are gone.  Empty
tables pass through; null texts fail the quality rules' base limit, like empty ones.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from synthlab.llm import decontaminate, pieces, quality, simhash, toxicity
from synthlab.session import materialise
from synthlab.sources.tables import load

#: the rows of run() depend on two learned stages, which SQL cannot express; the tests check every
#: stage against a plain version of its rule instead
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the learned decision list."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half by the factorization machine."""
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component: that with the smallest doc_id."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that are left."""
    return pieces.digests(docs, "piece_bpe_32k.model")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_text),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
