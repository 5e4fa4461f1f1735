import random

from trackloom.llm.components import connected_components


def brute(edges):
    label = {x: x for e in edges for x in e}
    while True:
        new = {x: min([label[x], *(label[b] for a, b in edges if a == x), *(label[a] for a, b in edges if b == x)]) for x in label}
        if new == label:
            return label
        label = new


def test_against_brute_force(spark):
    r = random.Random(2)
    edges = [(r.randrange(-20, 60), r.randrange(-20, 60)) for _ in range(45)] + [(1000 + i, 1001 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame([*edges, *edges, (None, 3)], "a long, b long")).collect()}
    want = {k: v for k, v in brute(edges).items() if any(k in e for e in edges if e[0] != e[1])}
    assert got == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_are_dealt_over_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from trackloom.llm import blocks

    monkeypatch.setattr(blocks, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(1, i) for i in range(60)] + [(2, i) for i in range(3)] + [(3, 9), (None, 1)], "key long, vertex long")
    got = sorted(tuple(r) for r in blocks.sized(rows, "key").select("key", "vertex", "n").collect())
    assert got == [(1, i, 60) for i in range(60)] + [(2, i, 3) for i in range(3)]
    left = blocks.dealt_join(rows, spark.createDataFrame([(1, "a"), (4, "b")], "key long, what string"), "key", "vertex", blocks.counts_of(rows, "key"), "left")
    assert left.count() == 65 and left.where("what = 'a'").count() == 60 and left.columns == ["key", "vertex", "what"]
    edges = [(0, i) for i in range(1, 40)] + [(100, i) for i in range(50, 90)] + [(39, 50)]
    assert {r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == {0}
