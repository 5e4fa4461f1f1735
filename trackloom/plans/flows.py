"""The stages one after another: detections to trajectories, clean tracks, clusters, outliers, features, scores."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, cleaning, clusters, features, optics, trajectories
from ..sources import tables
from .settings import resolved

ENDS = ["x_entry", "y_entry", "x_exit", "y_exit"]


def trajectories_of(detections: DataFrame, settings: dict[str, Any]) -> DataFrame:
    return trajectories.build_trajectories(detections, settings["dataset"]["fps"])


def clean_and_noise(moving: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean points, noise points, flags of tracks)."""
    with_speed = trajectories.with_speed(moving)
    flags = cleaning.flagged_tracks(with_speed)
    return *cleaning.split(with_speed, flags), flags


def clustered(clean: DataFrame, settings: dict[str, Any], normalise: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ends of tracks, their clusters)."""
    c = settings["dataset"]["cluster"]
    ends = trajectories.entry_exit(clean)
    points = cleaning.standardised(ends, ENDS) if normalise else ends
    return ends, optics.optics_clusters(points, ENDS, c["min_samples"], c["xi"], c["max_eps"])


def run(spark: SparkSession, detections: DataFrame, data_dir: str, settings: dict[str, Any] | None = None, groups: int = 8) -> dict[str, int]:
    """Writes every table of a scene and returns their numbers of rows. Features come from all tracks, labels from clean ones."""
    s = resolved(settings)
    at = tables.Layout(data_dir, s["dataset"]["name"])
    out = {"tracks": tables.write_parquet(detections, at.path("interim", "tracks"))}

    def kept(df: DataFrame, name: str) -> DataFrame:
        out[name] = tables.write_parquet(df, at.path("processed", name))
        return spark.read.parquet(at.path("processed", name))

    moving = kept(trajectories_of(spark.read.parquet(at.path("interim", "tracks")), s), "trajectories")
    clean, noise, flags = clean_and_noise(moving)
    clean = kept(clean, "trajectories_cleaned")
    kept(noise, "trajectories_noise")
    tables.write_parameters(cleaning.normalisation(clean), at.path("processed", "normalization_params.json"))
    ends, found = clustered(clean, s)
    found = kept(found, "optics")
    kept(found.select("track_id", "cluster"), "clusters")
    outliers = kept(clusters.outlier_table(ends, found), "outliers")
    kept(clusters.exit_groups(ends, groups), "exit_groups")
    kept(features.vectorise(moving, features.preset(s["features"]["preset"])), "features")
    top = clusters.top_outliers(outliers, 20).select("track_id")
    kept(moving.join(F.broadcast(top), "track_id", "left_semi"), "top_20_outlier_trajectories")  # 20 rows
    tables.write_csv(clusters.cluster_summary(clusters.clustered_ends(found.select("track_id", "cluster"), ends)), at.path("processed", "cluster_summary.csv"), "cluster")
    return out


def scores(spark: SparkSession, data_dir: str, scene: str, kind: str = "mlp", k: int = 5, repeats: int = 2) -> DataFrame:
    """Cross-validated scores of a classifier on a scene's tables; exit groups are the labels if they are there, else clusters."""
    at = tables.Layout(data_dir, scene)
    vectors = spark.read.parquet(at.path("processed", "features"))
    table = features.training_table(vectors, tables.if_there(spark, at.path("processed", "exit_groups")), tables.if_there(spark, at.path("processed", "clusters")))
    rows = features.as_array(table.drop("label")).join(table.select("track_id", "label"), "track_id")
    return classify.cross_validate(classify.make_model(kind), rows, k, repeats)
