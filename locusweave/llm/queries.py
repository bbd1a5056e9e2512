"""Registered queries of this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.llm import bpe, hard_negatives, language_id, line_dedup, mixing, neighbours, quality_classifier, quality_rules, secret_scan, simhash, token_counts, toxicity, whitening
from locusweave.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_id.predict(docs, model).alias("_p")).select("doc_id", "held_out", "_p.*")


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    machine = quality_classifier.fit(docs, table(spark, folder, "labels"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_classifier.score(docs, machine).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents"))


ORACLES["op7_quality_rules"] = quality_rules.SQL


@query
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), shift=None).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: Categories of the toxicity chain before the label itself: groups of the words that mark it.
GROUPS = 2


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    chain = toxicity.fit(docs, table(spark, folder, "labels"), GROUPS)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(docs, chain).alias("_p"))
    return out.select("doc_id", "held_out", *[F.col(f"_p.{c}").alias(f"p_{c}") for c in chain.categories], F.col("_p.toxic").alias("score"), (F.col("_p.toxic") >= 0.5).cast("int").alias("predicted"))


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: lines with enough words, how many of them go, and their numbers."""
    docs = table(spark, folder, "documents")
    found = line_dedup.gone_lines(docs).select(F.col("id").alias("_id"), "h", F.col("n").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join("gone", ",").alias("removed"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("h")), "left")
    return rows.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_lines", "n_removed")], F.coalesce("removed", F.lit("")).alias("removed"))


@query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, folder, "embeddings"))


@query
def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(table(spark, folder, "documents"))


ORACLES["op11_secret_scan"] = secret_scan.SQL


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = hard_negatives.SQL
