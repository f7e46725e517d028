"""Structured Streaming: files processed once across restarts, and windowed event counts.

The reference systems process files in a resumable loop; here the checkpoint of
a file stream is what has been done. Event windows are an extension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def process_new(
    spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], file_format: str = "json"
) -> StreamingQuery:
    """step over the files of source that no earlier run has seen, appended to out as Parquet; ends by itself."""
    reader = spark.readStream.schema(schema).format(file_format)
    if file_format == "json":
        reader = reader.option("multiLine", True)
    return step(reader.load(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "7 days") -> DataFrame:
    """Rows without repeats of a key; with a time column state is dropped after the delay."""
    return stream.dropDuplicates(keys) if time is None else stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, kind, n, total) of tumbling windows; works on streams and tables."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    marked = stamped.withWatermark(time, late) if events.isStreaming else stamped
    return marked.groupBy(F.window(time, size), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("window_start"), kind, "n", "total"
    )
