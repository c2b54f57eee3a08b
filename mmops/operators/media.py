"""Subtitles and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subtitles_at_frames(subtitles: DataFrame, frames: DataFrame, by: str, bucket_ms: int = 10_000) -> DataFrame:
    """J-10: subtitles (start_ms, end_ms) with any frame (ts in seconds) strictly inside, of the same group.

    Time is cut into buckets, so the join is by group and bucket, not of all frames with all subtitles of a group;
    a long subtitle is in several buckets and is kept once.
    """
    s = subtitles.withColumn("__id", F.monotonically_increasing_id())
    buckets = F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.greatest("start_ms", "end_ms") / bucket_ms))
    spread = s.select("__id", by, "start_ms", "end_ms", F.explode(buckets).alias("__b"))
    f = frames.select(F.col(by).alias("__by"), F.col("ts").alias("__ts"), F.floor(F.col("ts") * 1000 / bucket_ms).alias("__fb"))
    inside = (spread[by] == f["__by"]) & (F.col("__b") == F.col("__fb")) & (F.col("start_ms") / 1000.0 < F.col("__ts")) & (F.col("end_ms") / 1000.0 > F.col("__ts"))
    kept = spread.join(f, inside, "left_semi").dropDuplicates(["__id"])
    return kept.select(by, "start_ms", "end_ms")
