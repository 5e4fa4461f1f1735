"""Smoothed tracks with velocity and acceleration, entry and exit points, samples of tracks.

All windows of a track share one partitioning by ``track_id``, so that smoothing, both derivatives and an aggregate by track need one
exchange. A track is one window partition: boxes without a track (-1) are left out by default, as they are not one object.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null


def in_order(*ties: str) -> Window:
    return Window.partitionBy("track_id").orderBy("frame", *ties)


def smoothing_rows(win: int, poly: int) -> np.ndarray:
    """The projection of ``win`` equally spaced values on polynomials: row p gives the fitted value at place p."""
    powers = np.vander(np.arange(win, dtype=float) - win // 2, poly + 1)
    return powers @ np.linalg.pinv(powers)


def smoothed(v: str, place: Column, n: Column, order: Window, win: int, poly: int) -> Column:
    """Savitzky-Golay: a polynomial fitted to the ``win`` values around each place, to the first or last ones near the ends.

    Tracks shorter than ``win`` stay as they are.
    """
    rows, half = smoothing_rows(win, poly), win // 2
    at = {d: F.lag(v, -d).over(order) if d else F.col(v) for d in range(-(win - 1), win)}

    def fitted(p: int) -> Column:
        total = None
        for k in range(win):
            term = F.lit(float(rows[p, k])) * at[k - p]
            total = term if total is None else total + term
        return total

    out = F.when(n < win, F.col(v))
    for p in range(half):
        out = out.when(place == p, fitted(p))
    for p in range(half + 1, win):
        out = out.when(place == n - win + p, fitted(p))
    return out.otherwise(fitted(half))


def gradient(v: str, order: Window) -> Column:
    """Half the difference of the neighbours, by rows; at the ends the difference to the one neighbour; null for a single row."""
    before, after = F.lag(v).over(order), F.lead(v).over(order)
    return F.when(before.isNull(), after - F.col(v)).when(after.isNull(), F.col(v) - before).otherwise((after - before) / 2)


def build_trajectories(detections: DataFrame, fps: float, win: int = 9, poly: int = 2, ties: tuple[str, ...] = (), untracked: bool = False, frame_aware: bool = False) -> DataFrame:
    """track_id, frame, x, y, vx, vy, ax, ay. ``frame_aware`` divides by the frames between rows, where the default counts rows."""
    order, whole = in_order(*ties), Window.partitionBy("track_id")
    points = nan_to_null(detections).where("track_id is not null and cx is not null and cy is not null")
    if not untracked:
        points = points.where("track_id <> -1")
    placed = points.select("track_id", "frame", *ties, "cx", "cy", (F.row_number().over(order) - 1).alias("place"), F.count("*").over(whole).alias("n"))
    smooth = placed.withColumns({"x": smoothed("cx", F.col("place"), F.col("n"), order, win, poly), "y": smoothed("cy", F.col("place"), F.col("n"), order, win, poly)})

    def slope(v: str) -> Column:
        if not frame_aware:
            return gradient(v, order) * fps
        return F.try_divide(gradient(v, order), gradient("frame", order)) * fps

    moving = smooth.withColumns({"vx": slope("x"), "vy": slope("y")})
    return moving.withColumns({"ax": slope("vx"), "ay": slope("vy")}).select("track_id", "frame", "x", "y", "vx", "vy", "ax", "ay")


def nested(trajectories: DataFrame) -> DataFrame:
    """One row per track, its points in an array ordered by frame."""
    point = F.struct("frame", *(c for c in trajectories.columns if c not in ("track_id", "frame")))
    return trajectories.groupBy("track_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def unnested(tracks: DataFrame) -> DataFrame:
    return tracks.select("track_id", F.inline("points"))


def entry_exit(trajectories: DataFrame, x: str = "x", y: str = "y", skip_nulls: bool = True) -> DataFrame:
    """First and last coordinates of each track by frame. Nulls are skipped per coordinate, or not at all."""
    rows = trajectories.where("track_id is not null")

    def end(pick, column: str) -> Column:
        return pick(column, F.when(F.col(column).isNotNull(), F.col("frame"))) if skip_nulls else pick(F.struct(column), "frame")[column]

    return rows.groupBy("track_id").agg(
        end(F.min_by, x).alias("x_entry"), end(F.min_by, y).alias("y_entry"), end(F.max_by, x).alias("x_exit"), end(F.max_by, y).alias("y_exit")
    )


def every_tenth(trajectories: DataFrame) -> DataFrame:
    """About ten rows of each track: every k-th from the first, k a tenth of its length."""
    order, whole = in_order(), Window.partitionBy("track_id")
    numbered = trajectories.withColumns({"_place": F.row_number().over(order) - 1, "_n": F.count("*").over(whole)})
    return numbered.where(F.col("_place") % F.greatest(F.lit(1), F.floor(F.col("_n") / 10)) == 0).drop("_place", "_n")


def with_speed(trajectories: DataFrame) -> DataFrame:
    return trajectories.withColumns({"speed": F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), "accel": F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay"))})


def ordinals(tracks: DataFrame, name: str = "index") -> DataFrame:
    """Each track's place in the order of ids, from 0, found by ranges of ids: no task sorts the whole table."""
    spark = tracks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = tracks.repartitionByRange(parts, "track_id").sortWithinPartitions("track_id").withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy("track_id")))
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_in") - 1).cast("bigint")).drop("_part", "_in", "_before")
