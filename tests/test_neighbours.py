"""The block search against the catalogue's SQL, odd vectors and copies included."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import catalogue
from trackloom.operators import classify, neighbours


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Vectors of four components, many of them copies; among them null and empty ones, with missing components, NaN, infinite, shorter and longer."""
    r = np.random.default_rng(1)
    rows = [(i, [float(v) for v in r.integers(0, 4, 4) / 4 + (1e4 if i % 7 == 0 else 0)], int(r.integers(0, 3))) for i in range(400)]
    odd = [None, [], [None] * 4, [0.5, None, 0.25, 0.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [0.5, 0.25], [0.5, 0.25, 0.0, 0.0, 9.0]]
    rows += [(400 + 5 * i + j, v, (i + j) % 3 if j else None) for i, v in enumerate(odd) for j in range(5)]
    path = tmp_path_factory.mktemp("vectors") / "embeddings.parquet"
    con = duckdb.connect()
    con.sql("create table t (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    con.sql(f"copy t to '{path}' (format parquet)")
    return str(path.parent)


def test_nearest_labels_as_in_sql(spark, folder, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    got = {r.track_id: r.prediction for r in catalogue.QUERIES["m04_j10_nearest_neighbours"](spark, folder).collect()}
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet')")
    assert got == dict(con.sql(catalogue.ORACLE["m04_j10_nearest_neighbours"]).fetchall()) and len(got) == 88


def test_nearest_rows_without_rows(spark):
    none = spark.createDataFrame([], "row long, id long, label int, features array<double>")
    some = spark.createDataFrame([(1, 1, 2, [0.5])], none.schema)
    assert neighbours.nearest_rows(none, some, 3).count() == neighbours.nearest_rows(some, none, 3).count() == 0


def test_all_folds_at_once_are_fold_by_fold(spark, folder, monkeypatch):
    """The folds of all repeats in one search are what one search for each fold finds."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rows = catalogue.points(spark, folder)
    dealt = rows.withColumns({"fold0": F.col("track_id") % 3, "fold1": F.floor(F.col("track_id") / 7) % 3, "row": F.col("track_id") + 1000}).withColumn("features", F.col("features").cast("array<double>"))
    got = {(r.row - 1000, r.repeat): r.prediction for r in classify.Nearest().predict_folds(dealt, 3, 2).collect()}
    for repeat in range(2):
        for f in range(3):
            fold = F.col(f"fold{repeat}")
            want = classify.nearest_labels(dealt.where(fold != f), dealt.where(fold == f)).collect()
            assert len(want) > 100 and all(got[r.track_id, repeat] == r.prediction for r in want)
