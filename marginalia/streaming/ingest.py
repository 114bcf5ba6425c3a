"""Documents that arrive as files: stateless per-document work as a stream, and running counts in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def label_counts(stream: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """window, label, n of a stream (ts, label); rows later than the watermark are left out once a window has closed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "label").agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What the stream gives for the input that is there now."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
