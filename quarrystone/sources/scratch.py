"""Tables that cut lineage: in the folder that the cluster names in spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and all runs on this machine (tests), one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"quarrystone-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Whether Spark drops the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """df written to path and read again.  The shuffle files behind it serve no one any more and are dropped when the write ends."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written once and read again: what follows starts from files that outlive any executor."""
    return stored(df, f"{scratch_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}")
