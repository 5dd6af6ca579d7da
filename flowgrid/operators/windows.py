"""Count-based tumbling windows over a dense index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.schemas import WINDOW_ROWS


def count_windows(indexed: DataFrame, n: int, size: int = WINDOW_ROWS, index: str = "row_idx") -> DataFrame:
    """Rows of whole windows of ``size`` rows, with window_id; the tail that fills none goes."""
    return indexed.filter(F.col(index) < n // size * size).withColumn("window_id", F.floor(F.col(index) / size).cast("long"))


def window_manifest(rows: DataFrame, ts: str = "ts", target: str = "target", source_row: str = "source_row", index: str = "row_idx") -> DataFrame:
    """One row a window: its target is that of its last row; bounds, composition and purity."""
    first, last = (lambda c: F.min_by(c, index)), (lambda c: F.max_by(c, index))
    return (
        rows.groupBy("window_id")
        .agg(
            F.min(index).alias("start_index"),
            (F.max(index) + 1).alias("stop_index_exclusive"),
            last(target).alias("target"),
            F.count_if(F.col(target) == 0).alias("benign_rows"),
            F.count_if(F.col(target) == 1).alias("malicious_rows"),
            F.count("*").alias("_n"),
            first(ts).alias("start_ts"),
            last(ts).alias("end_ts"),
            first(source_row).alias("first_source_row"),
            last(source_row).alias("last_source_row"),
        )
        .withColumn("target_purity", F.when(F.col("target") == 1, F.col("malicious_rows")).otherwise(F.col("benign_rows")) / F.col("_n"))
        .withColumn("duration_seconds", F.col("end_ts") - F.col("start_ts"))
        .drop("_n")
    )


def mixed_windows(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_if(F.col("target_purity") < 1).alias("mixed_windows"), F.count("*").alias("windows"))
