"""Clusters and outliers of tracks: summaries, centroids, outlier tables, exit groups, joins with points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import INFINITY, midpoint, percent

ENDS = ("x_entry", "y_entry", "x_exit", "y_exit")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("size"))


def size_summary(clusters: DataFrame) -> DataFrame:
    return cluster_sizes(clusters).agg(F.max("size").alias("largest"), F.min("size").alias("smallest"), F.avg("size").alias("mean"), F.median("size").alias("median"), F.count("*").alias("n_clusters"))


def largest_clusters(clusters: DataFrame, k: int) -> DataFrame:
    return cluster_sizes(clusters).orderBy(F.desc("size"), "cluster").limit(k)


def outlier_stats(clusters: DataFrame) -> DataFrame:
    """Outliers, tracks, share, and clusters counted by the highest label and by distinct labels."""
    noise = F.count_if(F.col("cluster") == -1)
    return clusters.agg(
        noise.alias("n_outliers"), F.count("*").alias("n_total"), percent(noise, F.count("*")).alias("pct_outliers"),
        F.coalesce(F.max(F.when(F.col("cluster") >= 0, F.col("cluster") + 1)), F.lit(0)).cast("bigint").alias("n_clusters"),
        F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_labels"),
    )


def outlier_ids(clusters: DataFrame) -> DataFrame:
    return clusters.where("cluster = -1").select("track_id")


def outlier_table(ends: DataFrame, labelled: DataFrame) -> DataFrame:
    """The tracks of cluster -1 with their ends: an infinite reachability becomes twice the largest finite one (1 without any) and is flagged.

    ``labelled`` has track_id, index, cluster and reachability.
    """
    noise = labelled.where("cluster = -1").join(ends, "track_id")
    endless = F.col("reachability") == INFINITY
    top = noise.agg(F.coalesce(F.max(F.when(~endless, F.col("reachability"))), F.lit(1.0)).alias("_top"))
    out = noise.crossJoin(F.broadcast(top))  # one row
    return out.select("track_id", "index", *ENDS, F.when(endless, 2 * F.col("_top")).otherwise(F.col("reachability")).alias("reachability"), endless.alias("is_unreachable"))


def top_outliers(outliers: DataFrame, k: int) -> DataFrame:
    return outliers.orderBy(F.desc("reachability"), "track_id").limit(k)


def with_extent(tracks: DataFrame, trajectories: DataFrame) -> DataFrame:
    """``tracks`` (few) with the number of points of each and their extent; a track without points has 0."""
    found = trajectories.join(tracks.select("track_id"), "track_id", "left_semi").groupBy("track_id").agg(
        F.count("*").alias("duration"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")
    )
    return tracks.join(found, "track_id", "left").withColumn("duration", F.coalesce("duration", F.lit(0)).cast("bigint"))


def clustered_ends(clusters: DataFrame, ends: DataFrame) -> DataFrame:
    return clusters.where("cluster >= 0").join(ends, "track_id")


def centroids(clustered: DataFrame) -> DataFrame:
    """Per cluster: mean ends, size, the midpoint of the flow and its displacement."""
    mean = clustered.groupBy("cluster").agg(*(F.avg(c).alias(c) for c in ENDS), F.count("*").alias("size"))
    return mean.withColumns({
        "mid_x": midpoint(F.col("x_entry"), F.col("x_exit")), "mid_y": midpoint(F.col("y_entry"), F.col("y_exit")),
        "dx": F.col("x_exit") - F.col("x_entry"), "dy": F.col("y_exit") - F.col("y_entry"),
    })


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count("track_id").alias("size"), *(x for c in ENDS for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))))


def labelled(tracks: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``tracks`` with a label, -1 where there is none; of several labels of a track the largest counts."""
    one = labels.groupBy("track_id").agg(F.max(column).alias("label"))
    return tracks.join(one, "track_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def first_tracks(clusters: DataFrame, n: int) -> DataFrame:
    """The first n tracks of every cluster, by id."""
    order = Window.partitionBy("cluster").orderBy("track_id")
    return clusters.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")


def exit_groups(ends: DataFrame, k: int = 8, starts: int = 10, seed: int = 42) -> DataFrame:
    """track_id and exit_group: k-means on exit points, the best of several starts, groups numbered by their centres' place.

    Fewer tracks than groups have none: the result is empty.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["x_exit", "y_exit"], outputCol="features").transform(ends.where("x_exit is not null and y_exit is not null").select("track_id", "x_exit", "y_exit")).persist()
    n = points.count()  # and keeps the points
    if n < k:
        points.unpersist()
        return ends.where("false").select("track_id", F.lit(0).alias("exit_group"))
    with ThreadPool(min(4, starts)) as pool:  # starts are jobs of their own
        fitted = pool.map(lambda i: KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="group").fit(points), range(starts))
    best = min(fitted, key=lambda m: m.summary.trainingCost)
    rank = {g: i for i, (_, g) in enumerate(sorted((tuple(c), g) for g, c in enumerate(best.clusterCenters())))}
    number = F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), F.col("group"))
    return best.transform(points).select("track_id", number.cast("int").alias("exit_group"))
