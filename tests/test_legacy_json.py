import json

import pytest

from trackloom.plans.settings import CLASS_MAP
from trackloom.sources import legacy_json

def box(frame, label="bus", **more):
    return {"frameID": frame, "label": label, "confidence": 0.25, "X": frame / 64, "Y": 0.5, "Width": 0.125, "Height": 0.0625, **more}


BUS = {"id": 41, "detections": [box(20), box(21, X=0.75)]}


def read(spark, tmp_path, text, **options):
    (tmp_path / "x.json").write_text(text, encoding="utf-8")
    return legacy_json.read(spark, str(tmp_path / "x.json"), **options)


@pytest.mark.parametrize("layout", ["array", "lines", "wrapped"])
def test_every_box_is_a_row_whatever_the_layout(spark, tmp_path, layout):
    entities = [{"id": 100 + k, "detections": [box(f, "bus" if k else "tram") for f in range(k + 1)]} for k in range(3)]
    text = {"array": json.dumps(entities), "lines": "\n".join(["", *map(json.dumps, entities), "{broken", "[1]"]), "wrapped": json.dumps({"tracks": entities})}[layout]
    got = read(spark, tmp_path, text, class_map={"bus": 5})
    assert got.schema.names == ["frame", "track_id", "cls", "conf", "cx", "cy", "w", "h"]
    want = [(f, 100 + k, 5 if k else -1, 0.25, f / 64, 0.5, 0.125, 0.0625) for k in range(3) for f in range(k + 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_equal_lines_are_not_merged_and_have_no_class_without_a_map(spark, tmp_path):
    rows = read(spark, tmp_path, "\n".join([json.dumps(BUS)] * 3)).groupBy("frame", "cls").count().collect()
    assert {tuple(r) for r in rows} == {(20, -1, 3), (21, -1, 3)}


def test_histories_count_only_where_there_are_no_boxes(spark, tmp_path):
    path = {"history_X": [k / 8 for k in range(6)], "history_Y": [1 - k / 8 for k in range(4)]}
    rows = read(spark, tmp_path, json.dumps([{"id": 12, **path}, {**BUS, **path}])).collect()
    assert sorted((r.frame, r.cx, r.cy, r.cls) for r in rows if r.track_id == 12) == [(k, k / 8, 1 - k / 8, -1) for k in range(4)]
    assert sorted(r.frame for r in rows if r.track_id == 41) == [20, 21]


@pytest.mark.parametrize(("label", "cls"), [(4, 4), (True, 1), (2.0, -1), ("7", 7), (" 8 ", 8), ("bus", 5), ("dog", -1), (None, -1)])
def test_labels_by_json_type(spark, tmp_path, label, cls):
    assert read(spark, tmp_path, json.dumps([{"id": 1, "detections": [{"label": label}]}]), class_map=CLASS_MAP).first().cls == cls


@pytest.mark.parametrize(("given", "frame"), [({"frameID": 2.5}, 2), ({"frameID": 3.5}, 4), ({"frameID": None, "frame": 5}, 0), ({"frame": "6"}, 6), ({"frameID": "x"}, 0), ({}, 0)])
def test_frames(spark, tmp_path, given, frame):
    assert read(spark, tmp_path, json.dumps([{"id": 1, "detections": [given]}])).first().frame == frame


def test_wrapped_and_odd_documents(spark, tmp_path):
    assert read(spark, tmp_path, json.dumps({"z": [1], "n": 3, "tracks": [BUS, 5], "a": [{}]})).count() == 2
    assert read(spark, tmp_path, json.dumps(BUS)).count() == 2
    assert read(spark, tmp_path, json.dumps(BUS), compat=True).count() == 0  # its detections count as entities, and have nothing
    assert read(spark, tmp_path, "3").count() == 0
    assert read(spark, tmp_path, "").count() == 0
    assert read(spark, tmp_path, json.dumps([{"id": 1, "detections": [3], "history_X": [1], "history_Y": [1]}])).count() == 0
    assert read(spark, tmp_path, json.dumps([{"id": "9", "detections": [], "history_X": [1], "history_Y": [2]}])).first().track_id == 9
    assert read(spark, tmp_path, '[{"id": 1.9, "detections": [{"confidence": NaN, "X": "0.5", "Y": ""}]}]').first()[1:6] == (1, -1, 0.0, 0.5, 0.0)


def test_strict_numbers(spark, tmp_path):
    text = json.dumps([{"id": 1, "detections": [{"confidence": "high"}]}])
    assert read(spark, tmp_path, text).first().conf == 0.0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read(spark, tmp_path, text, strict=True).collect()
