"""Detection rows from per-frame results: the boundary to detectors and trackers.

A result is one row per frame: video, frame_no (any increasing number), boxes (array of corner boxes; class, confidence and id may be
null). Models themselves are plugged in: ``FrameSource`` runs a function over the files of a folder, ``assign_tracks`` runs one that
gives ids over the frames of each video in order.
"""

from __future__ import annotations

import glob
import importlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import box_centre, defaulted

RESULTS = "video string, frame_no bigint, boxes array<struct<x1:double,y1:double,x2:double,y2:double,cls:bigint,conf:double,id:bigint>>"


def detections(results: DataFrame, conf: float | None = None, classes: list[int] | None = None) -> DataFrame:
    """Detection rows; frames without boxes give none but are counted. ``conf`` and ``classes`` filter as a model would."""
    numbered = results.withColumn("frame", F.row_number().over(Window.partitionBy("video").orderBy("frame_no")) - 1)
    box = numbered.where(F.size("boxes") > 0).select("video", F.col("frame").cast("bigint").alias("frame"), F.explode("boxes").alias("b"))
    filled = defaulted(F.col("b.cls"), F.col("b.conf"), F.col("b.id"))
    rows = box.select("video", "frame", *(filled[c].alias(c) for c in ("track_id", "cls", "conf")), *(v.alias(k) for k, v in box_centre(*(F.col(f"b.{c}") for c in ("x1", "y1", "x2", "y2"))).items()))
    if conf is not None:
        rows = rows.where(F.col("conf") >= conf)
    return rows.where(F.col("cls").isin(classes)) if classes else rows


def assign_tracks(results: DataFrame, tracker: Callable[[], Callable[[list[dict]], list[dict]]]) -> DataFrame:
    """``results`` with ids from a tracker made anew for every video and fed its frames in order."""

    def run(frames: pd.DataFrame) -> pd.DataFrame:
        step = tracker()
        frames = frames.sort_values("frame_no", kind="stable")
        frames["boxes"] = [step([dict(b.asDict() if hasattr(b, "asDict") else b) for b in (boxes if boxes is not None else [])]) for boxes in frames["boxes"]]
        return frames[["video", "frame_no", "boxes"]]

    return results.groupBy("video").applyInPandas(run, RESULTS)


class FrameSource(DataSource):
    """spark.read.format("frames"): options ``path``, ``pattern``, ``recursive``, ``model`` (module:function); all options reach the model."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return RESULTS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in local_files(self.options["path"], self.options.get("pattern", "*"), self.options.get("recursive", "false") == "true")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, name = self.options["model"].split(":")
        model = getattr(importlib.import_module(module), name)
        for i, boxes in enumerate(model(partition.value, self.options)):
            yield partition.value, i, [tuple(b) for b in boxes]


def local_files(path: str, pattern: str = "*", recursive: bool = False) -> list[str]:
    """A file is itself; of a folder the matching files, sorted; nothing there is an error."""
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    return sorted(p for p in glob.glob(os.path.join(path, "**" if recursive else "", pattern), recursive=recursive) if os.path.isfile(p))


def discover(spark, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """The files at a path of any file system, as a sorted column; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", "length").orderBy("path")
