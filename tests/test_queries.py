"""Every query on tracks against its SQL, at the smallest size."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom import catalogue

FOLDER = "/root/testdata/sf0.001"
SLOW = ("cross_validated",)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.sql(f"create view {t.split('.')[0]} as select * from read_parquet('{FOLDER}/{t}')")
    return con


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if not any(s in n for s in SLOW)])
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) or name == "m16_empty_features"
    if name in catalogue.ORACLE:
        want = duck.sql(catalogue.ORACLE[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda df: sorted(map(repr, df[columns].itertuples(index=False, name=None)))
        assert rows(got) == rows(want)


def test_entry_without_the_text_operators(spark, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "text_queries", None)
    monkeypatch.setattr(__spark_entry__, "corpus_pipeline", None)
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) == set(catalogue.QUERIES)


def test_mann_whitney_of_all_events(spark, duck, tmp_path):
    """No id is left out: the statistic is that of plain ranks over all rows, ids far apart included."""
    duck.sql("select event_id, value from events union all select event_id + 5000, value + event_id % 2 from events").write_parquet(str(tmp_path / "events.parquet"))
    (got,) = catalogue.QUERIES["m09_mann_whitney_u"](spark, str(tmp_path)).collect()
    other = duckdb.connect()
    other.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    assert got.u == pytest.approx(other.sql(catalogue.ORACLE["m09_mann_whitney_u"]).fetchall()[0][0])
    ranked = "SELECT event_id % 2 = 0 AS one, rank() OVER (ORDER BY round(value, 0)) + (count(*) OVER (PARTITION BY round(value, 0)) - 1) / 2.0 AS r FROM events"
    assert got.u == pytest.approx(other.sql(f"SELECT sum(r) FILTER (one) - count(*) FILTER (one) * (count(*) FILTER (one) + 1) / 2.0 FROM ({ranked})").fetchall()[0][0])


def test_cross_validation_and_grid_search_are_whole(spark, monkeypatch):
    """10 folds, 3 times; 27 combinations."""
    fits = []
    monkeypatch.setattr(catalogue.classify, "make_model", lambda kind: type("Model", (), {"fit_predict": lambda self, train, test: fits.append(kind) or test.select("track_id", F.lit(0).alias("prediction"))})())
    for kind in ("knn", "svm", "dt", "mlp"):
        (name,) = (n for n in catalogue.QUERIES if n.endswith(f"cross_validated_{kind}"))
        assert "repeat" in catalogue.QUERIES[name](spark, FOLDER).columns
    assert [fits.count(k) for k in ("knn", "svm", "dt", "mlp")] == [30] * 4
    grid = []
    monkeypatch.setattr(catalogue.optics, "grid_search", lambda ends, columns, **g: grid.append(g) or spark.range(0).select(*(F.lit(0).alias(c) for c in ("n_clusters", "min_samples", "xi", "max_eps"))))
    catalogue.QUERIES["m13_f11_t08_grid_search"](spark, FOLDER)
    assert [len(v) for v in grid[0].values()] == [3, 3, 3]
