"""Detections from nested JSON: arrays of tracked entities, objects that wrap one, or one entity to a line."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import class_lookup, frame_number, number

ENTITY = "id string, history_X array<string>, history_Y array<string>, detections array<string>"
DETECTION = "label string, confidence string, X string, Y string, Width string, Height string, frameID string, frame string"
#: Bare NaN and infinities, which JSON lacks, count as null.
NOT_JSON = r"(?<=[:,\[\s])(NaN|-?Infinity)(?=[,\]}\s])"


def _is_object(text: Column) -> Column:
    return F.startswith(F.ltrim(text), F.lit("{"))


def _items(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def _single(text: Column) -> Column:
    """Whether a text is one JSON value and nothing after it (parsers stop at the end of the first)."""
    boxed = F.concat(F.lit("["), text, F.lit("]"))
    return F.try_parse_json(boxed).isNotNull() & (F.size(_items(boxed)) == 1)


def entities(texts: DataFrame, column: str = "value", compat: bool = False) -> DataFrame:
    """The entities, as JSON text, of rows that hold one document each.

    An array gives its objects. An object gives the objects of its first value that is a list starting with an object; with ``compat``
    off, an object that has detections or histories itself is one entity. Anything that isn't one JSON value is read by lines, of which
    those that are no objects are skipped.
    """
    text = F.trim(F.regexp_replace(F.col(column), NOT_JSON, "null"))
    rows = texts.select(text.alias("t")).withColumn("ok", _single(F.col("t")))
    table = F.from_json("t", "map<string,string>")
    keys = F.coalesce(F.json_object_keys("t"), F.array().cast("array<string>"))
    listed = F.filter(keys, lambda k: F.startswith(F.ltrim(F.try_element_at(table, k)), F.lit("[")) & _is_object(F.get(_items(F.try_element_at(table, k)), F.lit(0))))
    wrapped = F.coalesce(_items(F.try_element_at(table, F.get(listed, F.lit(0)))), F.array().cast("array<string>"))
    itself = F.arrays_overlap(keys, F.array(F.lit("detections"), F.lit("history_X"))) if not compat else F.lit(False)
    lines = F.filter(F.transform(F.split("t", r"\r\n|\r|\n"), F.trim), lambda x: _is_object(x) & _single(x))
    found = (
        F.when(F.col("ok") & F.startswith("t", F.lit("[")), _items(F.col("t")))
        .when(F.col("ok") & _is_object(F.col("t")) & itself, F.array("t"))
        .when(F.col("ok") & _is_object(F.col("t")), wrapped)
        .when(~F.col("ok"), lines)
    )
    return rows.select(F.explode(found).alias("entity")).where(_is_object(F.col("entity")))


def _label_class(detection: Column, label: Column, class_map: Mapping[str, int] | None) -> Column:
    """By the label's JSON type: whole numbers and booleans are classes, texts are looked up, anything else is unknown."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(detection), "$.label", "variant"))
    return (
        F.when(kind == "BIGINT", F.coalesce(label.try_cast("bigint"), F.lit(-1)))
        .when(kind == "BOOLEAN", (label == "true").cast("bigint"))
        .when(kind == "STRING", class_lookup(label, class_map))
        .otherwise(F.lit(-1))
        .cast("bigint")
    )


def rows_of(found: DataFrame, class_map: Mapping[str, int] | None = None, strict: bool = False) -> DataFrame:
    """Detection rows of entities: their detections, or their histories where there are none. ``strict`` raises on unreadable numbers."""
    parsed = found.select(F.from_json("entity", ENTITY).alias("e")).select("e.*")
    whole = F.coalesce(F.col("id").try_cast("bigint"), F.col("id").try_cast("double").try_cast("bigint"), F.lit(-1)).cast("bigint")
    parsed = parsed.select(whole.alias("track_id"), "history_X", "history_Y", "detections")
    has = F.coalesce(F.size("detections") > 0, F.lit(False))
    read = (lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("double"), F.lit(0.0))) if strict else number
    single = parsed.where(has).select("track_id", F.explode("detections").alias("d")).where(_is_object(F.col("d"))).withColumn("v", F.from_json("d", DETECTION))
    present = F.array_contains(F.json_object_keys("d"), "frameID")
    detected = single.select(
        frame_number(F.when(present, F.col("v.frameID")).otherwise(F.col("v.frame"))).alias("frame"), "track_id", _label_class(F.col("d"), F.col("v.label"), class_map).alias("cls"),
        *(read(F.col(f"v.{a}")).alias(b) for a, b in (("confidence", "conf"), ("X", "cx"), ("Y", "cy"), ("Width", "w"), ("Height", "h"))),
    )
    pairs = F.arrays_zip(F.coalesce("history_X", F.array().cast("array<string>")).alias("hx"), F.coalesce("history_Y", F.array().cast("array<string>")).alias("hy"))
    shorter = F.least(F.size(F.coalesce("history_X", F.array().cast("array<string>"))), F.size(F.coalesce("history_Y", F.array().cast("array<string>"))))
    remembered = parsed.where(~has).select("track_id", shorter.alias("n"), F.posexplode(pairs).alias("at", "p")).where("at < n")
    history = remembered.select(
        F.col("at").cast("bigint").alias("frame"), "track_id", F.lit(-1).cast("bigint").alias("cls"), F.lit(0.0).alias("conf"), F.col("p.hx").try_cast("double").alias("cx"), F.col("p.hy").try_cast("double").alias("cy"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h")
    )
    return detected.unionByName(history)


def read(spark: SparkSession, path: str, class_map: Mapping[str, int] | None = None, compat: bool = False, strict: bool = False) -> DataFrame:
    """Detections of all files at ``path``, each one document."""
    return rows_of(entities(spark.read.text(path, wholetext=True), compat=compat), class_map, strict)


def to_entities(detections: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """The way back: one JSON entity per track, in a column ``value``."""
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("cls").cast("int"))
    box = F.struct(F.col("frame").alias("frameID"), label.alias("label"), F.col("conf").alias("confidence"), F.col("cx").alias("X"), F.col("cy").alias("Y"), F.col("w").alias("Width"), F.col("h").alias("Height"))
    return detections.groupBy(F.col("track_id").alias("id")).agg(F.array_sort(F.collect_list(box)).alias("detections")).select(F.to_json(F.struct("id", "detections")).alias("value"))
