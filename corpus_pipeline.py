"""From raw documents to token digests, in five stages; each is written as Parquet and reread as the next one's documents.

1. Language: texts without a letter, and texts whose language stays undecided, go.
2. Lines: later lines that match an earlier line go; documents that lose all words go.
3. Near-duplicates: one document of each SimHash group stays.
4. Mix: documents come as often as the mix of sources takes them (not at all, once or twice); the mix keeps the mean log size of its input.
5. Tokens: digests of the encoded and decoded text, a row for each document taken.

Rows: null and empty texts go in stage 1 (no letter); very long texts are processed whole; copies fall in stages 2 and 3; an empty table
gives an empty table; columns besides those of ``documents`` are carried through stages 1 to 4.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.llm import bpe, language_id, line_dedup, mixing, simhash
from locusweave.llm.common import stored

TOKENIZER = "word_bpe_49k.json"
#: An undecided language below this score is a reject.
DECIDED = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    found = docs.select(F.struct(*docs.columns).alias("row"), language_id.predict(docs, model).alias("p"))
    kept = (F.col("p.lang_pred") != language_id.UNKNOWN) & (~F.col("p.ambiguous") | (F.col("p.score") >= DECIDED))
    return found.where(kept).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.cleaned(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), "n_chars")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, shift=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: SQL cannot express the classifier's stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the ``documents`` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
