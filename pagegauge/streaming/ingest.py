"""Files that keep arriving: the same measuring and rules over a stream, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measure
from ..plans.config import Settings


def arriving(spark: SparkSession, directory: str) -> DataFrame:
    """file, content of files as they land in a directory."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(directory)
    return rows.select(F.col("path").alias("file"), "content")


def ingest(spark: SparkSession, directory: str, out: str, checkpoint: str, pipeline: measure.Pipeline | None = None):
    """Measure and judge what has landed since the last run, append it to out, and stop; the checkpoint keeps files from coming twice."""
    p = pipeline or measure.Pipeline(settings=Settings(detector="mask-contour"), keep_images=False)
    rows = measure.judged(arriving(spark, directory), p).drop("image")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def verdict_rates(events: DataFrame, every: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Counts by verdict in windows of event time (columns ts, verdict); rows later than the watermark drop."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "verdict").agg(F.count(F.lit(1)).alias("n"))
