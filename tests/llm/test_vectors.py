import numpy as np
import pytest

from pyspark.sql import functions as F

from trackloom.llm import crosspoly, multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def around(r, centre, cos, n):
    z = r.normal(size=(n, len(centre)))
    z -= (z @ centre)[:, None] * centre
    z /= np.linalg.norm(z, axis=1)[:, None]
    return cos * centre + np.sqrt(1 - cos**2) * z


def rows_of(seed=0, d=20):
    r = np.random.default_rng(seed)
    base = r.normal(size=(60, d))
    base /= np.linalg.norm(base, axis=1)[:, None]
    x = [*base, *around(r, base[0], 0.995, 30), *around(r, base[1], 0.985, 20), *(3 * base[2:5]), *(base[0][None].repeat(5, 0))]
    rows = [(i, [float(v) for v in np.float32(x[i])], i % 2 if i > 80 else 0) for i in range(len(x))]
    odd = [(900, None, 0), (901, [0.0] * d, 0), (902, [float("nan")] * d, 0), (903, [None] + [1.0] * (d - 1), 0), (904, [float("inf")] + [1.0] * (d - 1), 0), (905, [], 0), (906, rows[0][1], None), (907, rows[0][1][:3], 0), (3, rows[3][1], 0)]
    return rows + odd


def brute_links(rows, least=0.98):
    d = max(len(v or []) for _, v, _ in rows)
    x = np.array([[(np.nan if c is None else c) for c in (v or [])] + [0.0] * (d - len(v or [])) for _, v, _ in rows], float)
    ok = np.isfinite(x).all(1) & (np.nan_to_num(x) != 0).any(1) & np.array([label is not None for *_, label in rows])
    x = np.where(ok[:, None], x, 0)
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    link = (u @ u.T >= least) & ok[:, None] & ok[None] & (np.array([[a[2] == b[2] for b in rows] for a in rows]))
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    ids = np.array([r[0] for r in rows])
    comp = ids.copy()
    for _ in range(len(label)):
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(comp))])
        if (new == comp).all():
            break
        comp = new
    return [(int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(1), comp, strict=True)]


@pytest.mark.parametrize("block", [1000, 7])
def test_links_and_components(spark, block):
    rows = rows_of()
    got = crosspoly.near_vectors(table(spark, rows), block=block).collect()
    assert sorted(map(tuple, got)) == sorted(brute_links(rows))


def test_magnitudes_lengths_and_labels(spark, tmp_path):
    r = np.random.default_rng(1)
    base = [float(v) for v in r.normal(size=5)]
    big = [(10, [1e-170, 2e-170], "a"), (11, [2e-170, 4e-170], "a"), (12, [1e200, 2e200], "a"), (13, [2e200, 4e200], "a"), (14, [5e-324, 1e-323], "a"), (None, [1.0, 2.0], "a"), (None, [7.0, -2.0], "a")]
    plain = [(i, [x * (1 + i) for x in base], "a" if i else "b") for i in range(4)] + [(20, [*base, 0.0, 0.0], "a"), (21, [0.0] * 65, "a")]
    schema = "vec_id long, embedding array<double>, label string"
    for k, part in enumerate((big, plain, [(30, base, "1.2"), (31, base, "1.7")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    got = {(r.vec_id, i): (r.n_links, r.component_id) for i, r in enumerate(sorted(crosspoly.near_vectors(spark.read.parquet(str(tmp_path / "v"))).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.n_links)))}
    by = {k: v for (k, _), v in got.items() if k is not None}
    assert all(by[i] == (5, 10) for i in range(10, 15)) and sorted((v for (k, _), v in got.items() if k is None), key=repr) == [(0, None), (5, 10)]
    assert by[0] == (0, 0) and all(by[i] == (3, 1) for i in (1, 2, 3, 20)) and by[21] == (0, 21) and by[30] == (0, 30) and by[31] == (0, 31)


def test_no_vectors(spark):
    assert crosspoly.near_vectors(table(spark, [])).count() == 0
    assert multi_index.nearest(table(spark, []), F.lit(True)).count() == 0
    assert multi_index.nearest(table(spark, [(1, None, 0)]), F.lit(True)).count() == 0
    assert multi_index.nearest(table(spark, [(1, [1.0, 2.0], 0)]), F.lit(True)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    np.testing.assert_allclose(np.linalg.norm(crosspoly.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    np.testing.assert_allclose(crosspoly.hadamard(crosspoly.hadamard(x)), x, atol=1e-12)


def test_few_candidates_are_all_returned_with_ties_by_id(spark):
    rows = [(20, [1.0, 0.0], 0), (1, [0.5, 1.0], 0), (2, [0.5, 9.0], 0), (3, [-2.0, 0.0], 0), (7, None, 0), (None, [1.0, 1.0], 0), (8, [2.0], 0)]
    got = multi_index.nearest(table(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 8, 2.0), (20, 2, 1, 0.5), (20, 3, 2, 0.5), (20, 4, 3, -2.0)]


@pytest.mark.parametrize("shard", [None, 100])
def test_recall_and_scores(spark, shard):
    r = np.random.default_rng(5)
    x = np.float32(np.concatenate((r.normal(size=(700, 24)), around(r, np.eye(24)[0], 0.99, 100), 4 * around(r, np.eye(24)[1], 0.9, 60)))).astype(float)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    got = {}
    for q in multi_index.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, shard=shard).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append((q.vec_id, q.score))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        kth = np.sort(s)[-20]
        assert len(found) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in found) and [v for _, v in found] == sorted((v for _, v in found), reverse=True)
        hits += sum(v >= kth - 1e-9 for _, v in found)
    assert len(got) == 43 and hits / (20 * len(got)) >= 0.9


def test_candidates_come_from_probing(monkeypatch):
    r = np.random.default_rng(2)
    x = np.concatenate((r.normal(size=(900, 16)), around(r, np.eye(16)[0], 0.999, 100)))
    index = multi_index.Shard(multi_index.fit(x, float(np.linalg.norm(x, axis=1).max())), np.arange(1000), x)
    bits = index.coder.codes(x[::50], True)
    code, far = np.packbits(bits, 1).view(np.uint64), None
    far = np.bitwise_count(code[:, None] ^ index.words[None]).sum(2, dtype=int)
    for radius in (0, 7, 30, 60, 110, multi_index.BITS):
        reach = np.full(len(bits), radius)
        q, rows = index.within(bits, reach)
        assert sorted(zip(q.tolist(), rows.tolist(), strict=True)) == [tuple(v) for v in np.argwhere(far <= radius).tolist()]
        # a row is retrieved exactly if one of its substrings is as near as the pigeonhole principle asks
        pieces = len(index.tables)
        near = [np.bitwise_count((a[:, None] ^ b[None, :]).astype(np.uint64)) <= radius // pieces - (j > radius % pieces) for j, (a, b) in enumerate(zip(index.cut(bits), index.cut(index.coder.codes(x, False)), strict=True))]
        assert (index.probed(bits, reach) == np.any(near, 0)).all()
    index.retrieved = 0
    index.within(bits, np.full(len(bits), 20))
    assert index.retrieved < 0.5 * far.size  # whole codes are not compared for other rows
    monkeypatch.setattr(multi_index.Shard, "probed", lambda self, bits, *_: np.zeros((len(bits), len(self.ids)), bool))
    assert len(index.search(np.zeros(5, int) - 1, x[:5], 3)[0]) == 0  # nothing comes by another way
