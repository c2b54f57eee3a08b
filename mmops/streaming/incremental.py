"""File-source streams (beyond what is asked for): new record files are checked and written as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.validation import check_records
from ..sources.readers import RECORD, normalise_media


def stream_records(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    return normalise_media(spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_a_batch).json(path))


def validate_stream(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Checks each new record and appends it, by validity; runs until the present files are done."""
    return check_records(records).writeStream.format("json").partitionBy("is_valid").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and kind; the state is bounded by the watermark. Works on streams and on tables."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return stamped.groupBy(F.window("__t", size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
