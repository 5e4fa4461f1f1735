"""Flags of noisy tracks, the split into clean and noise, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scalar import magnitude

MIN_DURATION, MIN_TRAVEL, EXTREME = 10, 0.05, 0.99
FLAGS = ("is_too_short", "is_too_fast", "is_too_jerky", "is_stationary")


def track_metrics(moving: DataFrame) -> DataFrame:
    """Per track: frames, largest speed and acceleration, extent and the diagonal of its box (the travel distance)."""
    per = moving.groupBy("track_id").agg(
        F.count("frame").alias("duration"), F.max("speed").alias("speed_max"), F.max("accel").alias("accel_max"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
    )
    return per.withColumns({"x_range": F.col("x_max") - F.col("x_min"), "y_range": F.col("y_max") - F.col("y_min")}).withColumn("travel_distance", magnitude(F.col("x_range"), F.col("y_range")))


def holds(condition: Column) -> Column:
    """A comparison with something missing is false."""
    return F.coalesce(condition, F.lit(False))


def noise_flags(metrics: DataFrame, speed_limit: float | None, accel_limit: float | None) -> DataFrame:
    over = lambda c, limit: holds(F.col(c) > F.lit(limit).cast("double"))
    flagged = metrics.withColumns({
        "is_too_short": holds(F.col("duration") < MIN_DURATION), "is_too_fast": over("speed_max", speed_limit),
        "is_too_jerky": over("accel_max", accel_limit), "is_stationary": holds(F.col("travel_distance") < MIN_TRAVEL),
    })
    return flagged.withColumn("is_noise", F.col(FLAGS[0]) | F.col(FLAGS[1]) | F.col(FLAGS[2]) | F.col(FLAGS[3]))


def flagged_tracks(moving: DataFrame) -> DataFrame:
    """Metrics with flags; the limits are the 99th percentiles over all points, exact."""
    points = moving.select("speed", "accel").persist()
    try:
        speed, accel = exact_quantiles(points, "speed", [EXTREME])[0], exact_quantiles(points, "accel", [EXTREME])[0]
    finally:
        points.unpersist()
    return noise_flags(track_metrics(moving), speed, accel)


def split(moving: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, noise) points: together the input, and disjoint."""
    noise = flags.where("is_noise").select("track_id")
    return moving.join(noise, "track_id", "left_anti"), moving.join(noise, "track_id", "left_semi")


def cleaning_summary(flags: DataFrame) -> DataFrame:
    """Counts and shares of clean and noisy tracks, durations of the clean ones, extents."""
    clean = F.when(~F.col("is_noise"), F.col("duration"))
    n = F.count("*")
    return flags.agg(
        n.alias("original_tracks"), F.count_if(~F.col("is_noise")).alias("clean_tracks"), F.count_if("is_noise").alias("noise_tracks"),
        F.try_divide(100.0 * F.count_if("is_noise"), n).alias("noise_pct"), F.min(clean).alias("clean_min"), F.max(clean).alias("clean_max"), F.avg(clean).alias("clean_mean"),
        F.min("x_min").alias("x_low"), F.max("x_max").alias("x_high"), F.min("y_min").alias("y_low"), F.max("y_max").alias("y_high"),
    )


def flag_counts(flags: DataFrame) -> DataFrame:
    """Per flag: how many tracks have it and their share."""
    stacked = flags.select(F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).alias("set")) for f in (*FLAGS, "is_noise")))).alias("s")).select("s.*")
    return stacked.groupBy("flag").agg(F.count_if("set").alias("n"), F.avg(F.col("set").cast("double")).alias("fraction"))


def normalisation(points: DataFrame) -> DataFrame:
    """One row: the extents that min-max scaling uses."""
    return points.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def min_max(points: DataFrame) -> DataFrame:
    """``points`` with x_norm and y_norm, null where an axis has no extent."""
    row = F.broadcast(normalisation(points))  # one row
    scaled = lambda c: F.try_divide(F.col(c) - F.col(f"{c}_min"), F.col(f"{c}_max") - F.col(f"{c}_min"))
    return points.crossJoin(row).withColumns({"x_norm": scaled("x"), "y_norm": scaled("y")}).drop("x_min", "x_max", "y_min", "y_max")


def standardised(table: DataFrame, columns: list[str], epsilon: float = 1e-10) -> DataFrame:
    """Z-score, then min-max with ``epsilon`` in the denominator, in closed form; a column without spread has scale 1."""
    aggregates = [x for c in columns for x in (F.min(c).alias(f"_{c}_lo"), F.max(c).alias(f"_{c}_hi"), F.stddev_pop(c).alias(f"_{c}_sd"))]
    row = F.broadcast(table.agg(*aggregates))  # one row

    def scaled(c: str) -> Column:
        sd = F.when(F.col(f"_{c}_sd") == 0, 1.0).otherwise(F.col(f"_{c}_sd"))
        return (F.col(c) - F.col(f"_{c}_lo")) / (F.col(f"_{c}_hi") - F.col(f"_{c}_lo") + epsilon * sd)

    return table.crossJoin(row).select(*(scaled(c).alias(c) if c in columns else F.col(c) for c in table.columns))
