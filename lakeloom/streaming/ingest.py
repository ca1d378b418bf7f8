"""Structured Streaming into the lake: each batch is accepted once and becomes one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakeloom.sources.lake import newest


def read_batches(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream over the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, lake: str, checkpoint: str, key: list[str]):
    """Append every batch under its own commit folder. A batch that runs again after a failure writes
    the same folder again, so that nothing is doubled; rows that repeat within it count once."""

    def commit(batch: DataFrame, seq: int) -> None:
        batch.dropDuplicates(key).withColumn("commit_seq", F.lit(seq).cast("long")).write.mode("overwrite").parquet(f"{lake}/commit={seq:012d}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, lake: str, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The newest row of each key over all commits: late rows count by their own time, not by arrival."""
    return newest(spark.read.parquet(f"{lake}/commit=*"), key, [*order, "commit_seq"], keep)


def windowed_counts(stream: DataFrame, at: str, by: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts by event-time window; rows later than the watermark no longer change a closed window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
