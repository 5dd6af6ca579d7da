"""Structured Streaming extension: the profiles of growing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def label_counts(stream: DataFrame, label: str) -> DataFrame:
    """Running counts by label; state grows with labels, not with rows."""
    return stream.groupBy(label).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, ts: str, label: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and label; what comes later than the watermark is dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), label).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), label, "n")


def first_of_hash(stream: DataFrame, by: str, ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each hash; hashes are forgotten once the watermark has passed them."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([by])


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now and stop; the checkpoint makes a later run go on from here."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
