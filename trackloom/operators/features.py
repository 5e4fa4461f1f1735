"""Feature vectors of tracks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each part of a vector is, in the vector's order: the columns taken, and the point of the track they are taken at.
PARTS = {
    "end": (("x", "y"), "e"),
    "end_velocity": (("vx", "vy"), "e"),
    "end_acceleration": (("ax", "ay"), "e"),
    "start": (("x", "y"), "s"),
    "middle": (("x", "y"), "m"),
}


@dataclass(frozen=True)
class FeatureSpec:
    """The parts that a vector has."""

    end: bool = False
    end_velocity: bool = False
    end_acceleration: bool = False
    start: bool = False
    middle: bool = False

    def chosen(self) -> list[tuple[str, str]]:
        """(column, point) of every number of the vector."""
        return [(c, at) for f in fields(self) if getattr(self, f.name) for columns, at in [PARTS[f.name]] for c in columns]

    @property
    def width(self) -> int:
        return len(self.chosen())


#: Fixed names: each adds a part to the one before.
PRESETS = {name: FeatureSpec(**dict.fromkeys(list(parts), True)) for name, parts in (("Re", ("end",)), ("ReVe", ("end", "end_velocity")), ("ReVeRs", ("end", "end_velocity", "start")))}


def preset(name: str) -> FeatureSpec:
    """The vector of that name; of any other, the largest."""
    return PRESETS[name] if name in PRESETS else max(PRESETS.values(), key=lambda spec: spec.width)


#: Which of n ordered rows a point is, from 0.
POINTS: dict[str, Callable[[Column], Column]] = {"s": lambda n: F.lit(0), "m": lambda n: F.floor(n / 2), "e": lambda n: n - 1}


def pick(n: Column, where: str) -> Column:
    """The place, from 0, of the start, middle or end of n rows."""
    if where not in POINTS:
        raise ValueError(f"a track has points {', '.join(POINTS)}, not {where!r}")
    return POINTS[where](n)


def vectorise(trajectories: DataFrame, spec: FeatureSpec) -> DataFrame:
    """track_id and the vector as float columns named 0, 1, ...: one aggregation by track, for the middle over its ordered points."""
    rows, chosen = trajectories.where("track_id is not null"), spec.chosen()
    if not chosen:
        return rows.select("track_id").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("frame", *dict.fromkeys(c for c, at in chosen if at == "m"))))
    first_or_last = {"s": F.min_by, "e": F.max_by}
    value = lambda c, at: F.get(ordered, pick(F.size(ordered), at).cast("int"))[c] if at == "m" else first_or_last[at](F.struct(c), "frame")[c]
    return rows.groupBy("track_id").agg(*(value(c, at).cast("float").alias(str(i)) for i, (c, at) in enumerate(chosen)))


def as_array(vectors: DataFrame) -> DataFrame:
    return vectors.select("track_id", F.array(*(F.col(c) for c in vectors.columns if c != "track_id")).cast("array<float>").alias("features"))


def training_table(vectors: DataFrame, exit_groups: DataFrame | None, clusters: DataFrame | None) -> DataFrame:
    """Vectors with a label: the exit group if there are any, else the cluster; -1 for tracks without one."""
    from .clusters import labelled

    if exit_groups is not None:
        return labelled(vectors, exit_groups, "exit_group")
    if clusters is not None:
        return labelled(vectors, clusters, "cluster")
    raise ValueError("no labels: neither exit groups nor clusters are there")
