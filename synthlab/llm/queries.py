"""Registered queries of the text operators: ``name -> (query(spark, sf_dir), DuckDB SQL or None)``.

Each query applies its operator with production parameters to a whole table and derives the
contract's digest columns from the operator's output.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from synthlab.sources.tables import load
from synthlab.llm import (align, decontaminate, embeddings, licences, oracle, pieces, quality, runs, sharding, simhash,
                          token_counts, token_files, toxicity, warc)

#: vocabulary files, by name in the public tokenizers' folder
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


@query(oracle.DECONTAMINATION)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, load(spark, sf_dir, "benchmark")).drop("text_md5")


@query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit_rules(docs, load(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, rules).drop("text")


@query(oracle.SHARDING)
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.assign_shards(docs, "doc_id", 16, ties=["size", "text_crc32"])
    return placed.withColumn("law", F.lit("key"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, machine).select("doc_id", "held_out", "score", "predicted")


@query()
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(load(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


@query()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(load(spark, sf_dir, "documents").select("doc_id", "text"), BYTES)


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(load(spark, sf_dir, "documents").select("doc_id", "text"), BYTES)


@query(oracle.LICENCES)
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(load(spark, sf_dir, "documents"), licences.known_licences(spark))


@query(oracle.WARC)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(load(spark, sf_dir, "pages"))


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_digests(load(spark, sf_dir, "documents").select("doc_id", "text"), BYTES, PIECES)


@query(oracle.EMBEDDINGS)
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(load(spark, sf_dir, "embeddings"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, those whose key's CRC-32 ends in 0 with the words from some place on repeated."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    cut = cut.withColumn("n", F.size("words"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)")))
    cut = cut.withColumn("p", F.when(F.col("n") > 0, F.expr("int(1 + (n - a) div (3 + g % 8))")))
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), int((n - a) div p + 1))), 1, n - a)")
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(load(spark, sf_dir, "documents").select("doc_id", "text")))
    # of equal exponents the earlier run stays: they are in order of start, then period
    best = F.reduce(F.slice("runs", F.lit(2), F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
                    lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))),
                                                   F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES["pipeline"] = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
