"""Column functions: boxes, labels, coercions, geometry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")


def box_centre(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """Centre and size of a box given by its corners."""
    return {"cx": (x1 + x2) / 2, "cy": (y1 + y2) / 2, "w": x2 - x1, "h": y2 - y1}


def defaulted(cls: Column, conf: Column, track: Column) -> dict[str, Column]:
    """A missing class is -1, confidence 0, track -1."""
    return {"cls": F.coalesce(cls, F.lit(-1)), "conf": F.coalesce(conf, F.lit(0.0)), "track_id": F.coalesce(track, F.lit(-1))}


def class_lookup(label: Column, class_map: Mapping[str, int] | None) -> Column:
    """The class of a text label: an integer in text first, then the map, else -1."""
    named = F.lit(None).cast("bigint")
    if class_map:
        named = F.try_element_at(F.create_map(*[F.lit(x) for kv in class_map.items() for x in kv]), label).cast("bigint")
    whole = F.when(label.rlike(r"^\s*[+-]?[0-9](_?[0-9])*\s*$"), F.regexp_replace(F.trim(label), "_", "").try_cast("bigint"))
    return F.coalesce(whole, named, F.lit(-1).cast("bigint"))


def number(value: Column) -> Column:
    """A text as a number: missing, empty or unreadable ones are 0."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")).try_cast("double"), F.lit(0.0))


def frame_number(value: Column) -> Column:
    """A text as a frame: rounded half to even; 0 if missing, unreadable or not finite."""
    x = value.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == INFINITY), F.lit(0)).otherwise(F.coalesce(F.bround(x).try_cast("bigint"), F.lit(0))).cast("bigint")


def magnitude(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2


def recommended_min_samples(n: Column) -> Column:
    """A fiftieth of the tracks, at least 10."""
    return F.greatest(F.lit(10), (0.02 * n).cast("int"))


def colour(cls: Column, colours: Mapping[int, tuple[int, int, int]]) -> Column:
    """Red, green and blue of a class; grey without one."""
    table = F.create_map(*[x for k, v in colours.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, cls), F.array(F.lit(200), F.lit(200), F.lit(200)))


def annotation(cls: Column, conf: Column, track: Column, names: Mapping[int, str] | None = None) -> Column:
    """Class (by name if known), confidence to two places, and the track's id if it has one."""
    name = cls.cast("string")
    if names:
        name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), cls), name)
    return F.concat(F.format_string("%s %.2f", name, conf), F.when(track >= 0, F.concat(F.lit(" ID:"), track.cast("string"))).otherwise(""))


def pixel(x: Column) -> Column:
    return x.cast("int")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing: null in every floating column, so that aggregates skip it and comparisons fail."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def kept_if_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that the table has, in the order asked for."""
    return df.select(*(c for c in columns if c in df.columns))


def float_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})
