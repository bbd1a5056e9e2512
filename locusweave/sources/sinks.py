"""Sinks. Outputs go to new paths: no job overwrites a table it reads. A small report is one file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.operators.keys import join_on


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet with zstd, rows of one partition value brought together so each writes few files.

    The rebalance is by size: adaptive execution splits a large partition value over many tasks and
    puts small ones together.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small report table as CSV with header, or JSON lines."""
    # A shuffle to one task, so that the work before it stays spread.
    writer = df.repartition(1).write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def materialize(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Read the table at ``path`` if it is there and complete, else build and read it.

    Complete means that the writer left its ``_SUCCESS`` file. A half-written table is replaced.
    """
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").select("length").first()
    except AnalysisException:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def with_section(summary: DataFrame, section: str) -> DataFrame:
    """Summary rows tagged with a section, so that further sections are appended, not merged in."""
    return summary.select(F.lit(section).alias("section"), "*")


def track_documents(df: DataFrame, record: Column, track: str, keys: Sequence[str], deal_on: Sequence[str], most: int = 1000) -> DataFrame:
    """Documents ``keys, track`` that hold about ``most`` records each, whatever the rows of one key.

    The rows of a key are counted first and dealt into shares by a hash of ``deal_on``, so a document does not grow with
    the table.
    """
    shares = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("_shares"))
    share = F.pmod(F.xxhash64(*deal_on), F.col("_shares")).alias("_share")
    dealt = join_on(df, shares, keys).select(*keys, share, record.alias("_record"))
    return dealt.groupBy(*keys, "_share").agg(F.collect_list("_record").alias(track)).drop("_share")
