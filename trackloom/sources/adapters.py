"""Detections out of the test tables: long tracks from events, short ones from lineitem; labels and reachabilities of tracks by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = """
SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
       CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 5 ELSE 7 END AS BIGINT) AS cls,
       CAST(event_id % 100 AS DOUBLE) / 100 AS conf, value / 1000 AS cx, CAST({k} AS DOUBLE) / 99 AS cy,
       CAST(user_id % 5 + 1 AS DOUBLE) / 100 AS w, CAST(user_id % 3 + 1 AS DOUBLE) / 100 AS h
FROM {events}"""
SHORT = """
SELECT l_orderkey AS track_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS frame,
       CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 7 END AS BIGINT) AS cls,
       l_discount * 10 AS conf, l_quantity / 50 AS cx, l_tax * 10 AS cy, CAST(0.02 AS DOUBLE) AS w, CAST(0.02 AS DOUBLE) AS h
FROM {lineitem}"""
#: A labelling of tracks by rule, for operators that take clusters: five clusters and noise, some of it unreachable.
LABELS = """
SELECT track_id, CAST(CASE WHEN track_id % 7 = 0 THEN -1 ELSE track_id % 5 END AS BIGINT) AS cluster,
       CASE WHEN track_id % 11 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST((track_id * 7919) % 1000 AS DOUBLE) / 1000 END AS reachability
FROM (SELECT DISTINCT track_id FROM {tracks}) AS ids"""


def long_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LONG.format(k="get_json_object(props, '$.k')", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def short_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SHORT, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def labels(spark: SparkSession, tracks: DataFrame) -> DataFrame:
    return spark.sql(LABELS, tracks=tracks)


#: The same as common table expressions of DuckDB.
DUCK_LONG = f"tracks AS ({LONG.format(k="(props->>'k')", events='events')})"
DUCK_SHORT = f"tracks AS ({SHORT.format(lineitem='lineitem')})"
DUCK_LABELS = f"labels AS ({LABELS.format(tracks='tracks')})"
