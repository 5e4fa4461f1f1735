import numpy as np
import pytest

from trackloom.operators import optics


def two_blobs(n=40):
    r = np.random.default_rng(1)
    return np.concatenate((r.normal(0, 0.05, (n, 4)), r.normal(3, 0.05, (n, 4))))


def test_blobs_are_clusters():
    labels, order, core, reach, _ = optics.optics(two_blobs(), 8, 0.05, np.inf)
    assert sorted(order) == list(range(80)) and np.isfinite(core).all() and np.isinf(reach[order[0]])
    assert len(set(labels[:40]) - {-1}) >= 1 and not (set(labels[:40]) & set(labels[40:]) - {-1})
    found = sorted(set(labels) - {-1})
    assert found == list(range(len(found)))


def test_far_points_are_noise_and_unreachable():
    x = np.concatenate((two_blobs(), [[50.0] * 4]))
    labels, _, _, reach, before = optics.optics(x, 8, 0.05, 1.0)
    assert labels[-1] == -1 and np.isinf(reach[-1]) and before[-1] == -1


def test_too_few_points_and_duplicates():
    assert (optics.optics(np.zeros((3, 4)), 5, 0.05, np.inf)[0] == -1).all()
    assert len(optics.optics(np.zeros((20, 4)), 5, 0.05, np.inf)[0]) == 20
    assert len(optics.optics(np.zeros((0, 4)), 5, 0.05, np.inf)[0]) == 0


def test_reachability_is_the_least_seen_when_reached():
    x = np.random.default_rng(3).normal(size=(30, 2))
    order, core, reach, before = optics.reach_order(x, 4, np.inf)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.testing.assert_allclose(core, np.sort(d, 1)[:, 3])
    for k, i in enumerate(order[1:], 1):
        done = order[:k]
        np.testing.assert_allclose(reach[i], np.maximum(core[done], d[done, i]).min())
        np.testing.assert_allclose(reach[i], max(core[before[i]], d[before[i], i]))


def test_scenes_and_grid(spark):
    x = two_blobs(20)
    rows = [(s, i, *map(float, p)) for s in "ab" for i, p in enumerate(x)]
    ends = spark.createDataFrame(rows, "scene string, track_id long, x_entry double, y_entry double, x_exit double, y_exit double")
    cols = ["x_entry", "y_entry", "x_exit", "y_exit"]
    got = optics.optics_clusters(ends, cols, 5, 0.05, 2.0, "scene").toPandas()
    assert got.groupby("scene").size().tolist() == [40, 40] and got.cluster.max() >= 1
    grid = optics.grid_search(ends.where("scene = 'a'"), cols, [5, 10], [0.05], [0.5, 2.0]).collect()
    assert len(grid) == 4 and all(r.pct_outliers == pytest.approx(100 * r.n_outliers / 40) for r in grid)
    assert optics.good_parameters(spark.createDataFrame([(7,), (8,), (20,), (21,)], "n_clusters long")).count() == 2


def test_a_grid_of_cells_changes_nothing():
    """Distances are asked for around a point only, and give the order that all distances give; copies, an outlier and one place included."""
    r = np.random.default_rng(4)
    x = np.concatenate((r.random((600, 4)), np.repeat(r.random((3, 4)), 40, 0), [[50.0, 0, 0, 0]]))
    for points, eps in ((x, 0.15), (x, 0.3), (np.zeros((50, 4)), 0.1), (x[:, :1], 0.0), (x, np.inf)):
        n = len(points)
        order, core, reach, before = optics.reach_order(points, 5, eps)
        d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
        want = np.sort(d, 1)[:, 4]
        want[want > eps] = np.inf
        np.testing.assert_allclose(core, want, rtol=1e-12)
        waiting, best = np.ones(n, bool), np.full(n, np.inf)
        for i in order.tolist():
            assert i == np.flatnonzero(waiting)[np.argmin(best[waiting])] and np.isclose(best[i], reach[i], rtol=1e-12)
            waiting[i] = False
            best = np.where(waiting & (d[i] <= eps) & np.isfinite(core[i]), np.minimum(best, np.maximum(d[i], core[i])), best)
        assert (before >= 0).sum() == np.isfinite(reach).sum()
    near = optics.Near(r.random((5000, 4)), 0.1)
    assert max(len(near.candidates(i)) for i in range(5000)) < 500
