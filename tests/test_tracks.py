from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import scalar
from trackloom.functions.quantiles import exact_quantiles
from trackloom.functions.ranks import upto
from trackloom.operators import charts, classify, cleaning, clusters, features, folds, stats
from trackloom.operators import trajectories as tr

POINTS = "track_id long, frame long, cx double, cy double"


def track(spark, xs, ys=None, track_id=1, step=1):
    return spark.createDataFrame([(track_id, i * step, float(x), float(x if ys is None else ys[i])) for i, x in enumerate(xs)], POINTS)


def built(df, **options):
    return tr.build_trajectories(df, 1.0, **options).orderBy("track_id", "frame").toPandas()


def test_smoothing_leaves_a_quadratic_as_it_is(spark):
    t = np.arange(20.0)
    got = built(track(spark, 3 + 2 * t - 0.5 * t**2))
    np.testing.assert_allclose(got.x, 3 + 2 * t - 0.5 * t**2, atol=1e-10)


@pytest.mark.parametrize("n", [2, 8, 9, 10, 31])
def test_smoothing_and_derivatives_against_polynomial_fits(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    want = v.copy()
    if n >= 9:
        for p in range(n):
            s = min(max(p - 4, 0), n - 9)
            want[p] = np.polyval(np.polyfit(np.arange(9), v[s : s + 9], 2), p - s)
    got = built(track(spark, v))
    np.testing.assert_allclose(got.x, want, atol=1e-9)
    np.testing.assert_allclose(got.vx, np.gradient(want), atol=1e-9)
    np.testing.assert_allclose(got.ax, np.gradient(np.gradient(want)), atol=1e-9)


def test_lines_single_points_gaps_and_untracked(spark):
    line = built(track(spark, 2 * np.arange(12.0)))
    np.testing.assert_allclose(line.vx, 2)
    np.testing.assert_allclose(line.ax, 0, atol=1e-12)
    one = built(track(spark, [5]))
    assert one.x[0] == 5 and np.isnan(one.vx[0]) and np.isnan(one.ax[0])
    gaps = track(spark, 2 * np.arange(5.0), step=4)
    assert set(built(gaps).vx) == {2.0} and set(built(gaps, frame_aware=True).vx) == {0.5}
    assert built(track(spark, [1, 2], track_id=-1)).empty and len(built(track(spark, [1, 2], track_id=-1), untracked=True)) == 2
    assert len(built(track(spark, [1, float("nan"), 3]))) == 2


def test_one_exchange_for_a_track(spark):
    moving = tr.with_speed(tr.build_trajectories(track(spark, range(10)), 30.0))
    plan = cleaning.track_metrics(moving)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_entry_exit_skips_nulls_or_not(spark):
    df = spark.createDataFrame([(1, 0, None, 1.0), (1, 1, 2.0, 3.0), (1, 2, 4.0, None)], "track_id long, frame long, x double, y double")
    assert tr.entry_exit(df).first() == (1, 2.0, 1.0, 4.0, 3.0)
    assert tr.entry_exit(df, skip_nulls=False).first() == (1, None, 1.0, 4.0, None)


def test_flags_split_the_points(spark):
    df = track(spark, np.arange(12.0) / 12).unionAll(track(spark, [0.5] * 12, track_id=2)).unionAll(track(spark, [0, 1, 0], track_id=3))
    moving = tr.with_speed(tr.build_trajectories(df, 1.0))
    flags = cleaning.flagged_tracks(moving)
    assert {r.track_id: (r.is_too_short, r.is_stationary, r.is_noise) for r in flags.collect()} == {1: (False, False, False), 2: (False, True, True), 3: (True, False, True)}
    clean, noise = cleaning.split(moving, flags)
    assert clean.count() == 12 and noise.count() == 15
    missing = spark.createDataFrame([(1, 20, None, float("inf"), 1.0)], "track_id long, duration long, speed_max double, accel_max double, travel_distance double")
    assert not cleaning.noise_flags(missing, 1.0, None).first().is_noise


@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_exact_quantiles(spark, n, monkeypatch):
    import trackloom.functions.quantiles as q

    monkeypatch.setattr(q, "FEW", 10)
    v = np.round(np.random.default_rng(n).normal(size=n), 2)
    v[: n // 3] = 0.5  # ties
    shares = [0.0, 0.05, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", shares)
    np.testing.assert_allclose(got, np.quantile(v, shares), atol=1e-12)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 4.0, 4.0], [3.0, 3.0], [0.0, 1.0]])
def test_histogram_like_numpy(spark, values):
    got = stats.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in got] == np.histogram(values, 5)[0].tolist()


def test_empirical_cdf_keeps_ties_apart(spark):
    got = stats.empirical_cdf(spark.createDataFrame([(2.0,), (1.0,), (2.0,), (9.0,)], "v double"), "v").orderBy("fraction").collect()
    assert [tuple(r) for r in got] == [(1.0, 0.25), (2.0, 0.5), (2.0, 0.75), (9.0, 1.0)]


def test_empirical_cdf_of_a_frequent_value_and_of_nothing(spark):
    values = [3.0] * 25_000 + [float(v) for v in range(100)] + [None, float("inf")]
    got = stats.empirical_cdf(spark.createDataFrame([(v,) for v in values], "v double"), "v").orderBy("fraction").collect()
    want = sorted(v for v in values if v is not None)
    assert [tuple(r) for r in got] == [(v, (i + 1) / len(want)) for i, v in enumerate(want)]
    assert stats.empirical_cdf(spark.createDataFrame([], "v double"), "v").count() == 0


def test_running_totals_over_ranges(spark):
    values = [-float("inf"), -3.0, 0.0, 1.5, 1e300, float("inf"), float("nan")]
    got = upto(spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)], "v double, n long"), "v", "n", "total").orderBy("total").collect()
    assert [r.total for r in got] == [sum(range(1, i + 2)) for i in range(7)] and [str(r.v) for r in got] == [str(v) for v in values]


def test_folds_of_a_frequent_label(spark):
    rows = spark.range(1000).selectExpr("id AS track_id", "CASE WHEN id % 10 < 8 THEN 'a' WHEN id % 10 = 8 THEN 'b' END AS label")
    got = classify.stratified_folds(rows, 3, 5)
    assert got.columns == ["track_id", "label", "fold"] and got.select("track_id").distinct().count() == 1000
    counts = {(r.label, r.fold): r["count"] for r in got.groupBy("label", "fold").count().collect()}
    assert counts == {(x, f): (n + 2 - f) // 3 for x, n in (("a", 800), ("b", 100), (None, 100)) for f in range(3)}


def test_random_rows_do_not_depend_on_the_layout(spark):
    rows = spark.range(500).selectExpr("id", "id / 7 AS v")
    assert {r.id for r in stats.random_rows(rows, 20, 3).collect()} == {r.id for r in stats.random_rows(rows.repartition(7), 20, 3).collect()}


def test_random_rows(spark):
    assert stats.random_rows(spark.range(50), 7, 1).distinct().count() == 7 and stats.random_rows(spark.range(3), 7, 1).count() == 3


def test_outliers_all_unreachable_and_none(spark):
    ends = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0)], "track_id long, x_entry double, y_entry double, x_exit double, y_exit double")
    labelled = spark.createDataFrame([(1, 0, -1, float("inf")), (2, 1, 0, 0.5)], "track_id long, index long, cluster long, reachability double")
    rows = clusters.outlier_table(ends, labelled).collect()
    assert [(r.track_id, r.reachability, r.is_unreachable) for r in rows] == [(1, 2.0, True)]
    assert "is_unreachable" in clusters.outlier_table(ends, labelled.where("cluster > 5")).columns


def test_features_by_preset(spark):
    t = np.arange(5.0)
    moving = tr.build_trajectories(track(spark, t, 10 * t), 1.0)
    assert list(features.vectorise(moving, features.preset("Re")).first()[1:]) == [4, 40]
    assert list(features.vectorise(moving, features.preset("nonsense")).first()[1:]) == [4, 40, 1, 10, 0, 0]
    assert list(features.vectorise(moving, features.FeatureSpec(middle=True)).first()[1:]) == [2, 20]
    empty = features.vectorise(moving.where("false"), features.preset("ReVeRs"))
    assert empty.count() == 0 and len(empty.columns) == 7
    with pytest.raises(ValueError, match="has points"):
        features.pick(F.lit(3), "x")


def test_labels_default_to_noise(spark):
    vectors = spark.createDataFrame([(1, 0.5), (2, 0.5)], "track_id long, `0` double")
    groups = spark.createDataFrame([(2, 4)], "track_id long, exit_group int")
    assert {r.track_id: r.label for r in features.training_table(vectors, groups, None).collect()} == {1: -1, 2: 4}
    with pytest.raises(ValueError, match="no labels"):
        features.training_table(vectors, None, None)


def test_scalar_functions(spark):
    row = spark.range(1).select(
        scalar.annotation(F.lit(2), F.lit(0.756), F.lit(4), {2: "car"}).alias("a"), scalar.annotation(F.lit(3), F.lit(0.5), F.lit(-1)).alias("b"), scalar.pixel(F.lit(-3.9)).alias("c"),
        scalar.percent(F.lit(1), F.lit(0)).alias("d"), scalar.recommended_min_samples(F.lit(5000)).alias("e"), scalar.colour(F.lit(9), {2: (1, 2, 3)}).alias("f"),
    ).first()
    assert tuple(row) == ("car 0.76 ID:4", "3 0.50", -3, 0.0, 100, [200, 200, 200])


def test_every_tenth_row_and_one_track(spark):
    moving = tr.build_trajectories(track(spark, np.arange(25.0)), 1.0)
    assert [r.frame for r in tr.every_tenth(moving).orderBy("frame").collect()] == list(range(0, 25, 2))
    assert charts.one_track(moving, 1).where("dx is not null").count() == 13


def blobs(spark, per=30):
    r = np.random.default_rng(0)
    rows = [(k * per + i, [float(v) for v in r.normal((k * 4, -k * 4), 0.4)], k) for k in range(3) for i in range(per)]
    return spark.createDataFrame(rows, "track_id long, features array<double>, label int")


@pytest.mark.parametrize("kind", ["KNN", "svm", "dt", "mlp"])
def test_models_tell_blobs_apart(spark, kind):
    rows = blobs(spark)
    found = classify.make_model(kind).fit_predict(rows.where("track_id % 3 <> 0"), rows.where("track_id % 3 = 0"))
    assert classify.balanced_accuracy(rows.join(found, "track_id")).first()[0] > 0.9
    with pytest.raises(ValueError, match="unknown"):
        classify.make_model("forest")


def test_cross_validation(spark):
    scores = classify.cross_validate(classify.make_model("knn"), blobs(spark, 10), 2, 2)
    assert scores.count() == 2 and classify.score_summary(scores).first()["mean"] > 0.9


def test_neighbours_at_distance_zero_vote_alone(spark):
    train = spark.createDataFrame([(1, [0.0], 5), (2, [0.1], 6), (3, [0.1], 6)], "track_id long, features array<double>, label int")
    test = spark.createDataFrame([(9, [0.0]), (8, [0.09])], "track_id long, features array<double>")
    assert {r.track_id: r.prediction for r in classify.nearest_labels(train, test).collect()} == {9: 5, 8: 6}


def test_mann_whitney(spark):
    side = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "score double")
    small = classify.mann_whitney(side([3, 4, 5]), side([1, 2])).first()
    assert small.u == 6 and small.p_value == pytest.approx(0.1) and not small.better  # one of the ten orders
    assert classify.mann_whitney(side(range(10, 20)), side(range(10))).first().better
    assert classify.mann_whitney(side([1, 1, 2]), side([1, 2, 2])).first().p_value > 0.5
    assert classify.mann_whitney(side([]), side([1])).first().p_value is None


def test_exit_groups_need_enough_tracks(spark):
    ends = spark.createDataFrame([(i, float(i % 4), float(i % 4)) for i in range(40)], "track_id long, x_exit double, y_exit double")
    rows = clusters.exit_groups(ends, 4, 3).collect()
    assert all((r.track_id % 4) == r.exit_group for r in rows)
    few = clusters.exit_groups(ends.limit(5))  # ends early, without groups
    assert few.columns == ["track_id", "exit_group"] and few.count() == 0


@pytest.mark.parametrize("kind", ["svm", "mlp"])
def test_folds_are_fitted_together(spark, kind, monkeypatch):
    model = classify.make_model(kind)
    monkeypatch.setattr(model, "fit_predict", None)  # no fold is fitted by itself
    rows = blobs(spark).unionByName(spark.createDataFrame([(900, None, 1)], "track_id long, features array<double>, label int"))
    scores = [r.score for r in classify.cross_validate(model, rows, 2, 2).collect()]
    assert len(scores) == 2 and 0.8 < min(scores) and max(scores) < 1  # the row without features counts as missed


def test_perceptrons_of_all_folds_are_fitted_in_one_job(spark, monkeypatch):
    model = classify.make_model("mlp")
    monkeypatch.setattr(type(model), "fit_predict", None)  # no fold is fitted by itself
    monkeypatch.setattr(folds.Blocks, "summed", None)  # no step is a job
    odd = spark.createDataFrame([(900, None, 1), (901, [1.0, None], 1), (902, [1.0, 1.0], None)], "track_id long, features array<double>, label int")
    scores = [r.score for r in classify.cross_validate(model, blobs(spark).unionByName(odd), 2, 2).collect()]
    assert len(scores) == 2 and 0.6 < min(scores) and max(scores) < 1  # rows without whole features or without a label count as missed


def test_perceptrons_held_by_tasks_or_step_by_step(spark, monkeypatch):
    """More rows than a task should hold: the same fits."""
    fits = [(r, f) for r in range(2) for f in range(3)]
    rows = blobs(spark).selectExpr("track_id AS row", "track_id", "features", "IF(track_id % 11 = 0, null, label) AS label", "int(track_id % 3) AS fold0", "int(track_id * 7 % 5 % 3) AS fold1").persist()
    found = []
    for most in (folds.HELD, 0):
        monkeypatch.setattr(folds, "HELD", most)
        blocks = folds.Blocks(rows, fits, 2)
        found.append(sorted(map(tuple, folds.perceptrons(blocks, (5, 4), 30, 1).collect())))
    assert found[0] == found[1] and len(found[0]) == 180


def test_sums_of_blocks_are_one_a_core(spark):
    n = 2048 * spark.sparkContext.defaultParallelism + 1
    blocks = folds.Blocks(spark.range(n).selectExpr("id AS row", "id AS track_id", "array(1.0D) AS features", "0 AS label", "0 AS fold0"), [(0, 1)], 1)
    assert blocks.data.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert blocks.summed(lambda _, row, x, code, fold: (x.sum(),), None) == [n]


def test_perceptrons_do_not_depend_on_the_order_of_blocks():
    r = np.random.default_rng(2)
    x, code, fold = r.normal(size=(600, 8)), r.integers(0, 4, 600), r.integers(0, 3, (1, 600))

    class Given(SimpleNamespace):
        def shared_out(self, work, short):
            (found,) = work(self.fits, [short(at, x[at], code[at], fold[:, at]) for at in self.order])
            return found.set_index("row")["code"].sort_index().tolist()

    fit = lambda order: folds.perceptrons(Given(fits=[(0, 1)], width=8, names=[0, 1, 2, 3], n=600, order=order), (16, 16), 300, 3)
    parts = np.array_split(r.permutation(600), 5)
    assert fit(parts) == fit(parts[::-1])


def test_perceptron_gradient():
    r = np.random.default_rng(0)
    shape, x, code = [3, 5, 4, 3], r.normal(size=(3, 2500)).astype(np.float32), r.integers(0, 3, 2500)
    w = r.normal(size=4 * 5 + 6 * 4 + 5 * 3)
    a, b, c = folds.layers(w, shape)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    z = sigmoid(sigmoid(x.T @ a[:-1] + a[-1]) @ b[:-1] + b[-1]) @ c[:-1] + c[-1]
    loss, slope = folds.entropy(w, shape, x, code)
    assert loss == pytest.approx((np.log(np.exp(z).sum(1)) - z[np.arange(2500), code]).sum(), rel=1e-5)
    step = 1e-2 * np.eye(len(w))
    ahead = [(folds.entropy(w + s, shape, x, code)[0] - folds.entropy(w - s, shape, x, code)[0]) / 2e-2 for s in step]
    assert slope == pytest.approx(np.array(ahead), rel=1e-2, abs=0.5)
    assert np.isfinite(folds.entropy(w * 1e4, shape, x, code)[0])  # sigmoids at their ends


def test_trees_of_all_folds_are_grown_in_one_job(spark, monkeypatch):
    model = classify.make_model("dt")
    monkeypatch.setattr(type(model), "fit_predict", None)  # no fold is fitted by itself
    odd = spark.createDataFrame([(900, None, 1), (901, [1.0, None], 1), (902, [1.0, float("nan")], 1)], "track_id long, features array<double>, label int")
    scores = [r.score for r in classify.cross_validate(model, blobs(spark).unionByName(odd), 2, 2).collect()]
    assert len(scores) == 2 and 0.8 < min(scores) and max(scores) < 1  # rows without whole features count as missed


def plain_tree(x, y, asked, depth):
    """By trying every split of every node."""
    names, counts = np.unique(y, return_counts=True)
    said = np.full(len(asked), names[counts.argmax()])
    pure = lambda part: (np.unique(part, return_counts=True)[1] ** 2).sum() / len(part)
    best = (-1, 0, 0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, j] <= cut
            if (now := pure(y[low]) + pure(y[~low])) > best[0]:
                best = (now, j, cut)
    if depth and len(names) > 1 and best[0] > 0:
        low, to = x[:, best[1]] <= best[2], asked[:, best[1]] <= best[2]
        said[to], said[~to] = plain_tree(x[low], y[low], asked[to], depth - 1), plain_tree(x[~low], y[~low], asked[~to], depth - 1)
    return said


@pytest.mark.parametrize("values", [3, 1000])
def test_tree_tries_every_split(spark, values):
    r = np.random.default_rng(values)
    x, y = r.integers(0, values, (150, 3)).astype(float), r.integers(0, 4, 150)
    frame = lambda at: spark.createDataFrame([(int(i), x[i].tolist(), int(y[i])) for i in at], "track_id long, features array<double>, label int")
    got = {p.track_id: p.prediction for p in classify.make_model("dt").fit_predict(frame(range(100)), frame(range(100, 150))).collect()}
    assert [got[i] for i in range(100, 150)] == plain_tree(x[:100], y[:100], x[100:], 14).tolist()


def test_tree_finds_one_value_among_many(spark):
    train = spark.range(3000).selectExpr("id AS track_id", "array(double(id)) AS features", "int(id = 1234) AS label")
    test = spark.createDataFrame([(-v, [float(v)]) for v in (1233, 1234, 1235)], "track_id long, features array<double>")
    assert {-r.track_id: r.prediction for r in classify.make_model("dt").fit_predict(train, test).collect()} == {1233: 0, 1234: 1, 1235: 0}
