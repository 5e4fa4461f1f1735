import json

import pytest

from trackloom.plans import flows, settings
from trackloom.sources import adapters, frames, tables
from trackloom.streaming.tracks import closed_tracks, read_stream


def test_frames_from_a_plugged_in_model(spark, tmp_path):
    for n in ("a.mp4", "b.mp4", "c.txt"):
        (tmp_path / n).write_text("x")
    spark.dataSource.register(frames.FrameSource)
    got = spark.read.format("frames").options(path=str(tmp_path), pattern="*.mp4", model="models:detector").load()
    rows = sorted((r.video[-5:], r.frame, r.track_id, r.cls, r.conf, r.cx, r.h) for r in frames.detections(got).collect())
    assert rows == [(v, f, *r) for v in ("a.mp4", "b.mp4") for f, r in ((0, (-1, 2, 0.9, 1.0, 4.0)), (2, (5, -1, 0.0, 1.5, 1.0)))]
    assert frames.detections(got, 0.5, [2]).count() == 2
    with pytest.raises(FileNotFoundError):
        frames.local_files(str(tmp_path / "none"))
    assert frames.local_files(str(tmp_path / "a.mp4")) == [str(tmp_path / "a.mp4")]
    assert frames.discover(spark, str(tmp_path), "*.mp4").count() == 2


class Counter:
    def __init__(self):
        self.n = 0

    def __call__(self, boxes):
        out = []
        for b in boxes:
            self.n += 1
            out.append({**b, "id": self.n})
        return out


def test_trackers_run_by_video(spark):
    box = {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "cls": 1, "conf": 0.5, "id": None}
    results = spark.createDataFrame([("v", 1, [box]), ("v", 0, [box, box]), ("w", 0, [box])], frames.RESULTS)
    got = frames.detections(frames.assign_tracks(results, Counter)).collect()
    assert sorted((r.video, r.frame, r.track_id) for r in got) == [("v", 0, 1), ("v", 0, 2), ("v", 1, 3), ("w", 0, 1)]


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"name": "here", "fps": 30, "cluster": {"min_samples": 40}}))
    s = settings.resolved(tmp_path / "s.json", {"detect.size": 640, "features.preset": "Re"})
    assert s["dataset"]["fps"] == 30 and s["dataset"]["cluster"] == {"min_samples": 40, "xi": 0.05, "max_eps": float("inf")}
    assert s["detect"]["imgsz"] == 640 and s["features"]["preset"] == "Re"
    assert settings.chosen_source({"dataset": {"video": "a"}}, None) == "a" and settings.chosen_source({"dataset": {}}, "b") == "b"
    with pytest.raises(ValueError, match="no source"):
        settings.chosen_source({"dataset": {}}, None)
    assert settings.class_map({"class_map": {"a": 1}, "dataset": {"class_map": {"b": 2}}}) == {"a": 1}
    with pytest.raises(RuntimeError, match="differ"):
        settings.palette({"dataset": {"colors": {"car": [1, 2, 3]}, "class_map": {"bus": 5}}})
    assert settings.palette({"dataset": {"colors": {"car": [1, 2, 3]}, "class_map": {"car": 2}}}) == {2: (1, 2, 3)}


def test_tables(spark, tmp_path):
    at = tables.Layout(str(tmp_path), "scene")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, k string")
    assert tables.write_parquet(df, at.path("interim", "t")) == 2
    assert tables.read_parquet(spark, at.path("interim", "t")).count() == 2
    assert tables.if_there(spark, at.path("interim", "no")) is None
    assert tables.first_there(spark, [at.path("interim", "no"), at.path("interim", "t")])[0].endswith("/t")
    with pytest.raises(FileNotFoundError):
        tables.first_there(spark, [at.path("raw", "no")])
    with pytest.raises(ValueError, match="stage"):
        at.path("cooked", "t")
    tables.write_csv(df, at.path("processed", "c"), "k")
    assert spark.read.option("header", True).csv(at.path("processed", "c")).columns == ["k", "n"]
    tables.write_parameters(df, at.path("processed", "p"))
    assert spark.read.json(at.path("processed", "p")).count() == 1


def test_stages_end_to_end(spark, tmp_path):
    detections = adapters.long_tracks(spark, "/root/testdata/sf0.001")
    written = flows.run(spark, detections, str(tmp_path), {"dataset": {"name": "x", "fps": 30, "cluster": {"min_samples": 3}}}, groups=3)
    assert written["trajectories"] == written["trajectories_cleaned"] + written["trajectories_noise"] == written["tracks"]
    assert flows.scores(spark, str(tmp_path), "x", "knn", 2, 1).count() == 1


def test_a_stream_closes_tracks(spark, tmp_path):
    rows = [(f, t, 0, 0.5, f / 10, t / 10, 0.1, 0.1) for t in (1, 2) for f in range(30)]
    schema = "frame long, track_id long, cls long, conf double, cx double, cy double, w double, h double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9000, 3, 0, 0.5, 0.0, 0.0, 0.1, 0.1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = closed_tracks(read_stream(spark, str(tmp_path / "in"), 9), 30.0).writeStream.format("memory").queryName("closed").outputMode("append").start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.track_id, r.first_frame, r.last_frame, r.points) for r in spark.table("closed").collect())
    assert got == [(1, 0, 29, 30), (2, 0, 29, 30)]
