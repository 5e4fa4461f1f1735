"""Profiles: per track and global statistics, quantiles, histograms, empirical distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.ranks import upto

#: How many rows of one value a step of the empirical distribution makes.
RUN = 10_000


def track_stats(trajectories: DataFrame) -> DataFrame:
    """One row per track: frames, and the spread of every coordinate; standard deviations are of samples, null for one point."""
    aggregates = [F.count("frame").alias("frame_count"), F.min("frame").alias("frame_min"), F.max("frame").alias("frame_max")]
    for c in ("x", "y"):
        aggregates += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    for c in ("vx", "vy", "ax", "ay"):
        aggregates += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return trajectories.groupBy("track_id").agg(*aggregates).withColumn("duration", F.col("frame_count"))


def describe(table: DataFrame, column: str) -> DataFrame:
    """Count, distinct count, min, max, mean and exact median of a column, as one row."""
    median = exact_quantiles(table, column, [0.5])[0]
    return table.agg(F.count(column).alias("n"), F.count_distinct(column).alias("n_distinct"), F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean")).withColumn("median", F.lit(median).cast("double"))


def quantiles(table: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """percent, value."""
    found = exact_quantiles(table, column, [p / 100 for p in percents])
    return table.sparkSession.createDataFrame([(p, v) for p, v in zip(percents, found, strict=True)], "percent int, value double")


def above_thresholds(table: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """percent, value and how many rows reach it."""
    found = exact_quantiles(table, column, [p / 100 for p in percents])
    rows = table.agg(*(F.count_if(F.col(column) >= v).alias(str(p)) for p, v in zip(percents, found, strict=True)))
    pairs = F.array(*(F.struct(F.lit(p).alias("percent"), F.lit(v).cast("double").alias("value"), F.col(str(p)).alias("n")) for p, v in zip(percents, found, strict=True)))
    return rows.select(F.inline(pairs))


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of a value, from 1; the last is closed on the right. Without extent, all values are in the middle of a widened range."""
    flat = low == high
    a, b = F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)
    return F.least(F.width_bucket(value, a, b, F.lit(bins)), F.lit(bins)).cast("int")


def histogram(table: DataFrame, column: str, bins: int) -> DataFrame:
    """bin and count of equal-width bins over the column's range, empty ones included."""
    spark = table.sparkSession
    values = table.select(F.col(column).alias("v")).where("v is not null and not isnan(v)")
    row = F.broadcast(values.agg(F.min("v").alias("low"), F.max("v").alias("high")))  # one row
    counts = values.crossJoin(row).groupBy(bin_of(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))


def histogram_2d(table: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """bx, by and count of the non-empty cells of a grid over the columns' ranges."""
    values = table.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    row = F.broadcast(values.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))  # one row
    cell = values.crossJoin(row).select(bin_of(F.col("x"), F.col("x0"), F.col("x1"), bins).alias("bx"), bin_of(F.col("y"), F.col("y0"), F.col("y1"), bins).alias("by"))
    return cell.groupBy("bx", "by").agg(F.count("*").alias("count"))


def empirical_cdf(table: DataFrame, column: str) -> DataFrame:
    """value and fraction: the i-th smallest value with i / n, ties apart.

    Ranks are found over the distinct values and their counts; a frequent value is spread in runs of ``RUN`` rows, so no task makes all.
    """
    values = table.select(F.col(column).cast("double").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    whole = F.broadcast(values.agg(F.sum("n").alias("all")))  # one row
    first = F.col("last") - F.col("n")
    runs = upto(values, "value", "n", "last").crossJoin(whole).select("value", "all", "last", F.explode(F.sequence(first + 1, F.col("last"), F.lit(RUN).cast("bigint"))).alias("start"))
    places = F.sequence("start", F.least(F.col("start") + RUN - 1, F.col("last")))
    return runs.repartition("value", "start").select("value", "all", F.explode(places).alias("place")).select("value", (F.col("place") / F.col("all")).alias("fraction"))


def largest_per_track(moving: DataFrame) -> DataFrame:
    return moving.groupBy("track_id").agg(F.max("speed").alias("speed_max"), F.max("accel").alias("accel_max"))


def random_rows(table: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, by a hash of their values: the same ones however the table is cut into files."""
    return table.orderBy(F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in table.columns))).limit(n)
