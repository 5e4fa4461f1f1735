import random
import tracemalloc

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from trackloom.llm import langid
from trackloom.llm._common import buffers
from trackloom.llm.queries import QUERIES

from data import documents

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ei", "ß"], "cc": ["ñ", "que", "ión", "lla"]}


def corpus(n, seed):
    r = random.Random(seed)
    make = lambda k: " ".join("".join(r.choice(SYLLABLES[k]) for _ in range(3)) for _ in range(r.randint(1, 40)))
    return [(i, make(k), k, "s", 0, 0.5, 1) for i, k in enumerate(r.choice(list(SYLLABLES)) for _ in range(n))]


def test_tells_languages_apart_and_keeps_columns(spark):
    rows = corpus(300, 1) + [(900, None, None, "s", 0, 0.5, 1), (901, "", "aa", "s", 0, 0.5, 1), (902, "12 34", "aa", "s", 0, 0.5, 1), (903, "kalomi " * 30_000, None, "s", 0, 0.5, 1), (None, "ungei", None, "s", 0, 0.5, 1)]
    docs = documents(spark, rows)
    found = langid.identify(docs, F.col("doc_id") % 2 == 0)
    assert found.columns == [*docs.drop("score").columns, "lang_pred", "score", "known"]
    assert langid.identify(docs, F.lit(False), added=("a", "b", "c")).columns == [*docs.columns, "a", "b", "c"]
    got = found.collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 2]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    assert by[900].score == 0 and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from_and_nothing_to_say(spark):
    docs = documents(spark)
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}
    assert langid.identify(docs.where("false"), F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.where("doc_id = 4"), F.lit(True)).collect()} == {"en"}


def test_held_out_accuracy_on_documents(spark):
    d = "/root/testdata/sf0.01"
    langs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    held = QUERIES["op9_language_id"](spark, d).where("held_out").join(langs, "doc_id").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
    assert held.agg(F.avg("ok")).first()[0] > 0.95


def test_like_the_plain_kernel_and_closed_form():
    """Sets of n-grams, the kernel between all landmarks and the closed-form ridge, without hashes or folding."""
    rows = [(t, k) for _, t, k, *_ in corpus(60, 5)] + [("Ünï é " * 30, "bb")]
    model = langid.fit(rows, landmarks=20)
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in s)
    held = lambda s: {fold(s)[i : i + n] for n in range(1, 5) for i in range(len(s) - n + 1)}
    k = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    sets = [held(t) for t, _ in rows]
    marks = [sets[i] for i in np.unique(np.linspace(0, len(sets) - 1, 20).astype(int))]
    values, vectors = np.linalg.eigh(np.array([[k(a, b) for b in marks] for a in marks]))
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    x = np.array([[k(a, b) for b in marks] for a in sets]) @ whiten
    y = np.array([[1.0 if lang == c else -1.0 for c in model.languages] for _, lang in rows])
    w = np.array([1 / sum(lang == mine for _, lang in rows) for _, mine in rows])
    w /= w.sum()
    mean, middle = w @ x, w @ y
    beta = np.linalg.solve((x - mean).T @ np.diag(w) @ (x - mean) + 1e-3 * np.eye(x.shape[1]), (x - mean).T @ np.diag(w) @ (y - middle))
    new = [t for _, t, *_ in corpus(15, 9)] + ["ß", "KALOMI ungei qué 漢字 12", "zzz"]
    want = np.array([[k(held(t), b) for b in marks] for t in new]) @ whiten @ beta + middle - mean @ beta
    raw, at = buffers(pa.array(new, pa.large_string()))
    got = langid.outputs(model, raw, at, langid.Distinct())
    assert got[0] == list(range(len(new)))
    np.testing.assert_allclose(got[1], want, atol=2e-5)
    np.testing.assert_allclose(got[2], [len(held(t) & set().union(*marks)) / len(held(t)) for t in new])


def test_distinct_and_index_with_shared_places():
    r = np.random.default_rng(0)
    keys = r.integers(0, 3000, 50_000).astype(np.uint64) * np.uint64(1 << 41)  # two keys a place
    distinct = langid.Distinct()
    assert sorted(distinct(keys).tolist()) == np.unique(keys).tolist() and len(distinct(keys[:0])) == 0
    index = langid.Index(np.unique(keys)[::2])
    number = index(keys)
    assert (index.keys[number[number > 0]] == keys[number > 0]).all() and ((number > 0) == np.isin(keys, np.unique(keys)[::2])).all()


def test_memory_does_not_grow_with_the_batch():
    model = langid.fit([(text, lang) for _, text, lang, *_ in corpus(60, 1)])
    texts = [*[t for _, t, *_ in corpus(6000, 2)] * 4, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    tracemalloc.start()
    try:
        parts, peak = list(langid.identified(iter([batch]), model, ["id", "text", *langid.ADDED])), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    whole = langid.predict(model, *buffers(pa.array([t or "" for t in texts], pa.large_string())), langid.Distinct())
    rows = pa.Table.from_batches(parts)
    assert rows.column("id").to_pylist() == list(range(len(texts))) and rows.column("lang_pred").to_pylist() == [[*model.languages, "und"][i] for i in whole[0]]
    assert np.array_equal(rows.column("score").to_numpy(), whole[1]) and np.array_equal(rows.column("known").to_numpy(), whole[2])
    assert len(parts) > 1 and peak < 90e6, peak
