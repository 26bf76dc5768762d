"""Incremental jobs on Structured Streaming: granule intake, passes, cell-month counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cryoframe.operators.spatial import cell
from cryoframe.schema import POINTS, nan_to_null


def intake(
    spark: SparkSession, source: str, sink: str, checkpoint: str, *, schema: T.StructType = POINTS, roi: Mapping[str, float] | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None, max_files: int | None = None,
) -> StreamingQuery:
    """Append each new granule file once; the checkpoint of the file source replaces the test for an existing output.

    Runs what is there and stops; run it again and only new files are read. A batch is
    written under its own id, so a batch repeated after a failure replaces itself. An
    unreadable file fails its batch, which is not marked as done and runs again once the
    file is mended or moved away.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    rows = nan_to_null(reader.parquet(source))
    if roi:
        rows = rows.where(F.col("lon").between(roi["lon_min"], roi["lon_max"]) & F.col("lat").between(roi["lat_min"], roi["lat_max"]))
    if transform:
        rows = transform(rows)

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch").parquet(sink)
        )

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pass_sessions(rows: DataFrame, *, key: str, time: str, gap: str, late: str, value: str) -> DataFrame:
    """Passes on arriving rows: a session closes after ``gap`` without a row of its key.

    Rows later than ``late`` behind the watermark are dropped; batch jobs have no such rule.
    """
    return (
        rows.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("pass"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value_sum"), F.min(time).alias("first"), F.max(time).alias("last"))
        .select(key, "first", "last", "n", "value_sum")
    )


def cell_month_counts(rows: DataFrame, *, time: str, late: str, size: float, x: str = "x", y: str = "y", window: str = "30 days") -> DataFrame:
    """Counts per cell and tumbling window, emitted once the watermark has passed the window."""
    return (
        rows.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), cell(x, size).alias("cell_x"), cell(y, size).alias("cell_y"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "cell_x", "cell_y", "n")
    )


def run_available(df: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Drain a stream to Parquet in append mode and read the result."""
    q = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(sink)
