"""The rows behind the charts; drawing them is left to whoever asks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import first_tracks, largest_clusters, top_outliers
from .trajectories import every_tenth, with_speed


def outlier_scatter(outliers: DataFrame) -> DataFrame:
    return outliers.select("track_id", "x_entry", "y_entry", "x_exit", "y_exit", "reachability", "is_unreachable")


def outlier_arrows(outliers: DataFrame, k: int = 50) -> DataFrame:
    return top_outliers(outliers, k).select("track_id", "x_entry", "y_entry", (F.col("x_exit") - F.col("x_entry")).alias("dx"), (F.col("y_exit") - F.col("y_entry")).alias("dy"), "reachability")


def flow_arrows(clusters: DataFrame, clustered: DataFrame, k: int = 6) -> DataFrame:
    """Entry and displacement of every track of the k largest clusters."""
    top = F.broadcast(largest_clusters(clusters, k).select("cluster"))  # k rows
    return clustered.join(top, "cluster", "left_semi").select("cluster", "track_id", "x_entry", "y_entry", (F.col("x_exit") - F.col("x_entry")).alias("dx"), (F.col("y_exit") - F.col("y_entry")).alias("dy"))


def sample_paths(clusters: DataFrame, trajectories: DataFrame, k: int = 4, n: int = 10) -> DataFrame:
    """The points of the first n tracks of each of the k largest clusters."""
    top = F.broadcast(largest_clusters(clusters, k).select("cluster"))  # k rows
    chosen = first_tracks(clusters.join(top, "cluster", "left_semi"), n).select("track_id", "cluster")
    return trajectories.join(F.broadcast(chosen), "track_id").select("cluster", "track_id", "frame", "x", "y")  # k times n rows


def cluster_paths(clusters: DataFrame, trajectories: DataFrame, cluster: int) -> DataFrame:
    """The points of all tracks of one cluster."""
    return trajectories.join(clusters.where(F.col("cluster") == cluster).select("track_id"), "track_id", "left_semi").select("track_id", "frame", "x", "y")


def one_track(trajectories: DataFrame, track_id: int, background: bool = False) -> DataFrame:
    """A track's points, about ten of them with velocity arrows a thirtieth of a second long; on request all other tracks behind it."""
    own = trajectories.where(F.col("track_id") == track_id)
    arrows = every_tenth(own).select("frame", (F.col("vx") / 30).alias("dx"), (F.col("vy") / 30).alias("dy"))
    out = own.select("track_id", "frame", "x", "y").join(arrows, "frame", "left").select("track_id", "frame", "x", "y", "dx", "dy", F.lit(False).alias("background"))
    if background:
        rest = trajectories.where(F.col("track_id") != track_id)
        out = out.unionByName(rest.select("track_id", "frame", "x", "y", F.lit(None).cast("double").alias("dx"), F.lit(None).cast("double").alias("dy"), F.lit(True).alias("background")))
    return out


def clean_and_noise(ends: DataFrame, flags: DataFrame) -> DataFrame:
    """Ends, duration and largest speed of every track, with whether it is noise."""
    return ends.join(flags.select("track_id", "is_noise", "duration", "speed_max"), "track_id")


def speeds(trajectories: DataFrame) -> DataFrame:
    return with_speed(trajectories).select("track_id", "frame", "speed", "accel")
