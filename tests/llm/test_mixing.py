import duckdb
import pytest

from trackloom.llm import mixing

from data import ODD, documents

SOURCES = [("big", 60), ("mid", 12), ("small", 3)]


def corpus():
    rows, i = [], 0
    for s, n in SOURCES:
        for k in range(n):
            rows.append((i, "word " * (1 + k % 7), "en", s, 0, 0.5, 1))
            i += 1
    return rows


@pytest.mark.parametrize("rows", [corpus(), corpus() + ODD, ODD[3:4], []])
@pytest.mark.parametrize("options", [{}, {"evenness": 0.99, "repeats": 1.5, "block_tokens": 16}, {"evenness": 0.999, "repeats": 50.0, "budget": 2.5, "block_tokens": 8, "block_docs": 5}])
def test_like_the_sql(spark, rows, options):
    docs = documents(spark, rows)
    got = mixing.mixed(docs, **options)
    assert got.columns[: len(docs.columns)] == docs.columns
    documents_ = docs.select("doc_id", "source", "text").toArrow()
    con = duckdb.connect()
    con.register("documents", documents_)
    want = con.sql(f"SELECT doc_id, source, n_tokens, weight, copies FROM ({mixing.oracle(**options)})").fetchall()
    mine = [(r.doc_id, r.source or "", r.mix_tokens, r.mix_weight, r.mix_copies) for r in got.collect()]
    assert sorted(mine, key=repr) == sorted(want, key=repr)


def test_quotas_are_met(spark):
    rows = mixing.mixed(documents(spark, corpus()), evenness=0.9, repeats=4.0, block_tokens=16).collect()
    total = sum(r.mix_tokens for r in rows)
    for s, _ in SOURCES:
        own = [r for r in rows if r.source == s]
        quota = own[0].mix_weight * total
        assert 0 <= quota + 1 - sum(r.mix_tokens * r.mix_copies for r in own) <= 9 and len({r.mix_weight for r in own}) == 1
        assert max(r.mix_copies for r in own) - min(r.mix_copies for r in own) <= 1
    assert sum(r.mix_copies for r in rows if r.source == "small") > 3 > 0


def test_no_python_in_the_plan(spark):
    plan = mixing.mixed(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_clashing_names_many_sources_and_empty_texts(spark, monkeypatch):
    names = "doc_id long, text string, source string, weight double, passes long, block string, mix_tokens string, Mix_Copies int, row string, plan string, `a.b` int"
    rows = [(i % 40 if i % 3 else None, "word " * (i % 5), "s" if i % 2 else None, 0.5, 1, "b", "m", 2, "r", "p", 7) for i in range(60)]
    docs = spark.createDataFrame(rows, names)
    got = mixing.mixed(docs, block_tokens=16)
    assert got.columns == [c for c in docs.columns if c.lower() not in mixing.ADDED] + list(mixing.ADDED)
    first = sorted(map(tuple, got.collect()), key=repr)
    assert {r[3:6] for r in first} == {(0.5, 1, "b")} and {r[-4] for r in first} == {7}
    monkeypatch.setattr(mixing, "FEW", 1)
    assert sorted(map(tuple, mixing.mixed(docs, block_tokens=16).collect()), key=repr) == first
    assert mixing.mixed(docs, added=("x", "y", "z")).columns == [*docs.columns, "x", "y", "z"]
    empty = spark.createDataFrame([(i, "", "s") for i in range(50)], "doc_id long, text string, source string")
    assert {r.mix_copies for r in mixing.mixed(empty, block_docs=5).collect()} == {1}
