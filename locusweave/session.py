"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "locusweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and a fixed time zone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Groups kept in hash maps before lists, sets and percentiles fall back to sorting.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(session: SparkSession) -> str:
    """The folder for intermediate data that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session (tests, a laptop) has none, a fresh temporary one is set; elsewhere the
    setting must be there.
    """
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it as a Parquet table in the shared folder and read it back.

    A lost executor then costs no more than the tasks it held, and later plans start from a columnar
    scan of known size. The tables stay until the folder is emptied.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
