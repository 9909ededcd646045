"""Structured Streaming paths: ledgers, the dual timeline with late data, and the repair queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrystone.operators.reconcile import merged_repairs

#: Files of a ledger that are in flight at once.
FILES_PER_BATCH = 16


def ledger_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """An append-only JSONL ledger; a bounded number of files is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def first_seen(stream: DataFrame, key: str, time: str | None = None, within: str = "1 hour") -> DataFrame:
    """The first row of each key: within a watermark where there is a time column, else over all that came."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def latest_by_key(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest order of each key; for update or complete mode."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(key, *(F.col("_v")[c].alias(c) for c in rest))


def business_windows(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and bounds of business time by window.  Business time alone drives the watermark; the time a row came in never does."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width))
        .agg(F.count("*").alias("events"), F.min(time).alias("first_event"), F.max(time).alias("last_event"))
        .select(F.col("window.start").alias("window_start"), "events", "first_event", "last_event")
    )


def repair_queue(stream: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Merges observed repair entries into a snapshot under state_path, one version for each batch; a batch that is run again writes the same version."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        columns = ["entry", "severity", "recorded", "attempts", "resolved_at"]
        known = spark.createDataFrame([], batch.select(*columns).schema)
        if epoch > 0:
            old = spark.read.parquet(f"{state_path}/version={epoch - 1}")
            known = old.select("entry", "severity", F.col("last_recorded").alias("recorded"), "attempts", "resolved_at")
        merged = merged_repairs(known, batch.select(*columns))
        resolved = batch.select("entry", "resolved_at").unionByName(known.select("entry", "resolved_at")).groupBy("entry").agg(F.max("resolved_at").alias("resolved_at"))
        # an entry that was seen again after it was resolved is open, and stays so in later batches
        kept = F.when(F.col("status") == "resolved", F.col("resolved_at")).alias("resolved_at")
        merged.join(resolved, "entry", "left").select(*merged.columns, kept).write.mode("overwrite").parquet(f"{state_path}/version={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
