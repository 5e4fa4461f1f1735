import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trackloom.llm import bloom_lm
from trackloom.llm._common import fold

from data import ODD, documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("top", [1 << 18, 3])
def test_base_is_exact_and_scores_are_close(spark, monkeypatch, top):
    monkeypatch.setattr(bloom_lm, "TOP", top)
    rows = ODD + [(100 + i, f"{'The' if i % 2 else 'A'} cat number{i % 7} sat on mat{i}", "en", "s", 0, 0.5, 1) for i in range(60)]
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None]) for i, t, *_ in rows]
    held = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 10
    count = Counter(t for i, ts in tokens if held(i) for t in ts)
    total, kinds = sum(count.values()), len(count)
    got = bloom_lm.score(documents(spark, rows), fold("doc_id", 10) != 0, fold("doc_id", 10) == 0).collect()
    key = lambda r: (repr(r[0]), r[2])
    want = [(i, held(i) == 0, len(ts), sum(count[t] > 0 for t in ts), total, sum(math.log10((count[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in ts)) for i, ts in tokens]
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5] and g.base_score == pytest.approx(w[5], rel=1e-9) and math.isfinite(g.score)
    seen = [g for g in got if g.doc_id and g.doc_id >= 100]
    assert sum(g.score for g in seen) > sum(g.base_score for g in seen)


def test_filter_keeps_levels(monkeypatch):
    monkeypatch.setattr(bloom_lm, "FLOORS", 4)
    import pyarrow as pa

    r = np.random.default_rng(0)
    gram = np.sort(r.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2))
    n, kind = r.zipf(1.6, 20_000).clip(1, 10**6), r.integers(0, 2, 20_000)
    batch = pa.RecordBatch.from_arrays([pa.array(bloom_lm.segment(gram)), pa.array(kind), pa.array(gram.view(np.int64)), pa.array(n)], names=["segment", "kind", "gram", "n"])
    rows = [tuple(x) for b in bloom_lm.build(iter([batch.slice(0, 7001), batch.slice(7001)])) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    model = bloom_lm.Filter(rows, 10**6, 20_000)
    for k in (0, 1):
        g, want = gram[kind == k], bloom_lm.levels(n[kind == k], k)
        found = model.level(g, k)
        assert (found >= want).all() and (found == want).mean() > 0.9
        assert (model.level(r.integers(0, 2**63, 5000).astype(np.uint64), k) > 0).mean() < 0.05


def test_full_segments_raise_their_floor(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bloom_lm, "CAPACITY", 50)
    gram = np.arange(300, dtype=np.uint64)
    n = np.where(np.arange(300) < 20, 1000, 1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(300, np.int64)), pa.array(np.ones(300, np.int64)), pa.array(gram.view(np.int64)), pa.array(n)], names=["segment", "kind", "gram", "n"])
    (out,) = bloom_lm.build(iter([batch]))
    floor = out.column(1)[0].as_py()
    assert floor > 1
    model = bloom_lm.Filter([(0, floor, out.column(2)[0].as_py())], 1, 1)
    assert (model.level(gram[:20], 1) == 10).all() and (model.level(gram[20:], 1) == 0).mean() > 0.9


def test_empty_table_and_nothing_to_learn_from(spark):
    learn = fold("doc_id", 10) != 0
    assert bloom_lm.score(documents(spark, []), learn, ~learn).count() == 0
    rows = bloom_lm.score(documents(spark), fold("doc_id", 10) > 99, learn).collect()
    assert len(rows) == len(ODD) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


def test_no_count_is_lost_however_many_there_are(spark, monkeypatch):
    """CAPACITY, SLICE and COLLECTED are far passed: no word that was learnt reads as unseen, and slices don't change scores."""
    monkeypatch.setattr(bloom_lm, "CAPACITY", 1)
    rows = [(i, " ".join(f"w{i}x{j} the" for j in range(30)), "en", "s", 0, 0.5, 1) for i in range(80)] + ODD
    learn, kept, make = fold("doc_id", 10) != 0, [], bloom_lm.Filter.__init__

    def watched(self, *a):
        make(self, *a)
        kept.append(self)

    monkeypatch.setattr(bloom_lm.Filter, "__init__", watched)
    whole = {(r.doc_id, r.n_tokens): r.score for r in bloom_lm.score(documents(spark, rows), learn, ~learn).collect()}
    assert len(kept) == 1
    for _, _, raw, at in bloom_lm.chunks(bloom_lm.pa.array([rows[i][1] for i in range(80) if zlib.crc32(str(i).encode()) % 10], bloom_lm.pa.large_string())):
        token, _, upto = bloom_lm.tokens(raw, at)
        word, pair = kept[0].found(token, upto)
        assert (word >= 1).all() and (pair >= 1).all() and (word == 1).mean() > 0.4
    monkeypatch.setattr(bloom_lm, "SLICE", 20_000)
    monkeypatch.setattr(bloom_lm, "COLLECTED", 8_000)
    sliced = {(r.doc_id, r.n_tokens): r.score for r in bloom_lm.score(documents(spark, rows), learn, ~learn).collect()}
    assert len(kept) > 3 and whole.keys() == sliced.keys() and all(sliced[k] == pytest.approx(v, rel=1e-12) for k, v in whole.items())


def test_weights_are_fitted_on_all_learning_texts(spark, monkeypatch):
    """Every token of every learning text counts, and the table of levels gives the weights that the texts give."""
    rows = [(i, f"w{i % 50} the a w{i % 7}", "en", "s", 0, 0.5, 1) for i in range(4000)]
    learn, seen, fit = fold("doc_id", 10) != 0, [], bloom_lm.Filter.fit_counts
    monkeypatch.setattr(bloom_lm.Filter, "fit_counts", lambda self, *a: seen.append((a[3].sum(), *a[:4])) or fit(self, *a))
    docs = documents(spark, rows)
    (row, *_) = bloom_lm.score(docs, learn, ~learn).collect()
    assert seen[0][0] == row.train_tokens == 5 * docs.where(learn).count() > 5 * 3000
    _, first, level, pair, n = seen[0]
    a, b = (bloom_lm.Filter([], 100, 10) for _ in range(2))
    fit(a, first, level, pair, n)
    fit(b, *(np.repeat(x, n) for x in (first, level, pair)), 1)
    assert np.allclose(a.weight, b.weight)
