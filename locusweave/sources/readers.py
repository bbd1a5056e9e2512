"""File sources. Each returns a lazy DataFrame with an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from locusweave.sources.schemas import RAW_PAIRS


def read_pairs(spark: SparkSession, path: str, schema: StructType = RAW_PAIRS, partitions: int | None = None) -> DataFrame:
    """Comma-separated pair observations with a header. A gzip file arrives as one task, so pass
    ``partitions`` to spread it before any work is done."""
    df = spark.read.csv(path, schema=schema, header=True, sep=",", enforceSchema=False)
    return df.repartition(partitions) if partitions else df


def read_tsv(spark: SparkSession, path: str | Sequence[str], schema: StructType, null: str = "NA", lineage: str | None = None) -> DataFrame:
    """Tab-separated files (a path, a glob or a list) under one schema; ``lineage`` names a column
    that will hold the file each row came from."""
    df = spark.read.csv(
        list(path) if not isinstance(path, str) else path,
        schema=schema, header=True, sep="\t", nullValue=null,
    )
    return df.select("*", F.col("_metadata.file_path").alias(lineage)) if lineage else df


def read_dataset(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Multi-part Parquet; filters, columns and nested fields are pruned by the scan."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_track(spark: SparkSession, path: str, track: str, fields: str) -> DataFrame:
    """JSON documents holding an array of records, one row per record. ``fields`` is the DDL of a
    record, e.g. ``"chrom string, chromStart long, chromEnd long, name string"``."""
    docs = spark.read.json(path, schema=f"`{track}` array<struct<{fields}>>", multiLine=True)
    return docs.select(F.inline(F.col(track)))


def small_dimension(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A literal lookup table, typed in code and therefore small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), ddl))
