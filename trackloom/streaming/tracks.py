"""Tracks of a stream of detections: each closes when its object has not been seen for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DETECTIONS


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Detections from a folder that new Parquet files come into."""
    return spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def closed_tracks(detections: DataFrame, fps: float, gap_seconds: int = 2, late_seconds: int = 5) -> DataFrame:
    """track_id, first and last frame, points, entry and exit of every track, once ``gap_seconds`` have passed without it.

    Frames are event time from 1970; rows later than ``late_seconds`` behind the newest are dropped. Works on tables as well.
    """
    at = F.timestamp_micros((F.col("frame") * F.lit(1_000_000 / fps)).cast("bigint"))
    rows = detections.where("track_id <> -1").withColumn("at", at).withWatermark("at", f"{late_seconds} seconds")
    return rows.groupBy("track_id", F.session_window("at", f"{gap_seconds} seconds")).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("points"),
        F.min_by("cx", "frame").alias("x_entry"), F.min_by("cy", "frame").alias("y_entry"), F.max_by("cx", "frame").alias("x_exit"), F.max_by("cy", "frame").alias("y_exit"),
    ).drop("session_window")
