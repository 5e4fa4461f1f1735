"""Classifiers and their evaluation: models by name, stratified cross-validation, balanced accuracy, Mann-Whitney."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import upto
from . import folds
from .neighbours import nearest_rows


def voted(near: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and prediction from (``by``, near_label, d): votes weighted by inverse distance; at distance 0 only those vote. Ties go to the smaller label."""
    touching = F.max(F.coalesce((F.col("d") == 0).cast("int"), F.lit(0))).over(Window.partitionBy(*by))
    weighed = near.withColumn("_touching", touching).withColumn("w", F.when(F.col("_touching") == 1, F.coalesce((F.col("d") == 0).cast("double"), F.lit(0.0))).otherwise(F.try_divide(F.lit(1.0), F.col("d"))))
    votes = weighed.groupBy(*by, "near_label").agg(F.sum("w").alias("vote"))
    first = Window.partitionBy(*by).orderBy(F.desc_nulls_last("vote"), F.asc_nulls_last("near_label"))
    return votes.withColumn("_place", F.row_number().over(first)).where("_place = 1").select(*by, F.col("near_label").alias("prediction"))


def nearest_labels(train: DataFrame, test: DataFrame, k: int = 7) -> DataFrame:
    """track_id and predicted label of the test rows: votes of the k nearest (``neighbours``). Rows of one id are searched as one."""
    features = F.col("features").cast("array<double>").alias("features")
    id_ = F.col("track_id").cast("long").alias("id")
    tests = test.select(F.lit(None).cast("long").alias("id"), F.col("track_id").cast("long").alias("row"), F.lit(None).cast(train.schema["label"].dataType).alias("label"), features)
    near = nearest_rows(train.select(id_, F.col("track_id").cast("long").alias("row"), "label", features), tests, k)
    best = Window.partitionBy("row").orderBy(F.asc_nulls_last("d"), F.asc_nulls_last("near_id"))
    once = near.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k)
    return voted(once, ["row"]).select(F.col("row").cast(test.schema["track_id"].dataType).alias("track_id"), "prediction")


class Nearest:
    """k nearest neighbours with the interface of the models below."""

    def __init__(self, k: int = 7) -> None:
        self.k = k

    def fit_predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return nearest_labels(train, test, self.k)

    def predict_folds(self, rows: DataFrame, k: int, repeats: int) -> DataFrame:
        """row, repeat and prediction, for all folds of all repeats at once: each pair of rows is compared once."""
        found = nearest_rows(rows.withColumnRenamed("track_id", "id"), rows.withColumnRenamed("track_id", "id"), self.k, repeats)
        return voted(found, ["row", "repeat"])


class Together:
    """A model that is fitted to all folds of all repeats at once (``folds``)."""

    def found(self, blocks: folds.Blocks) -> DataFrame:
        raise NotImplementedError

    def predict_folds(self, rows: DataFrame, k: int, repeats: int, fits: list[tuple[int, int]] | None = None) -> DataFrame:
        """row, repeat and prediction; rows without a whole vector have none."""
        blocks = folds.Blocks(rows, fits or [(r, f) for r in range(repeats) for f in range(k)], repeats)
        if not blocks.names or not blocks.width:
            return rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"), F.lit(None).cast(blocks.kind).alias("prediction"))
        names = F.array(*(F.lit(x) for x in blocks.names))
        return self.found(blocks).select("row", "repeat", F.get(names, F.col("code")).cast(blocks.kind).alias("prediction"))

    def fit_predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """One fit: the test rows are the fold left out."""
        kind = train.schema["label"].dataType
        part = lambda df, label, f: df.select(F.col("track_id").cast("long").alias("row"), F.col("track_id").cast("long").alias("track_id"), F.col("features").cast("array<double>").alias("features"), label.alias("label"), F.lit(f).alias("fold0"))
        both = part(train, F.col("label"), 1).unionByName(part(test, F.lit(None).cast(kind), 0))
        return self.predict_folds(both, 1, 1, [(0, 0)]).select(F.col("row").cast(test.schema["track_id"].dataType).alias("track_id"), "prediction")


class Perceptron(Together):
    """Two hidden layers of 64. The layers are sigmoid, fitted by L-BFGS, without early stopping or a penalty on weights."""

    def found(self, blocks: folds.Blocks) -> DataFrame:
        return folds.perceptrons(blocks, (64, 64), 500, 42)


class RadialMachine(Together):
    """A support-vector machine with a radial kernel, C = 2, by random Fourier features (Rahimi and Recht, 2007) and one linear machine a class."""

    def __init__(self, size: int = 128, cost: float = 2.0, seed: int = 42) -> None:
        self.size, self.cost, self.seed = size, cost, seed

    def found(self, blocks: folds.Blocks) -> DataFrame:
        return folds.machines(blocks, self.size, self.cost, self.seed)


class Tree(Together):
    """A decision tree of depth 14 by Gini impurity. Nothing in it is drawn: equally good splits go to the first feature and the smallest value."""

    def __init__(self, depth: int = 14) -> None:
        self.depth = depth

    def found(self, blocks: folds.Blocks) -> DataFrame:
        return folds.trees(blocks, self.depth)


def make_model(kind: str):
    """knn, svm, dt or mlp, in any case."""
    makers = {"knn": Nearest, "svm": RadialMachine, "dt": Tree, "mlp": Perceptron}
    if kind.lower() not in makers:
        raise ValueError(f"unknown classifier: {kind}")
    return makers[kind.lower()]()


def stratified_folds(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """``rows`` with fold 0 .. k - 1, each label spread evenly, in an order drawn from the seed.

    A label is dealt by hash into as many parts as there are shuffle partitions, so that no task numbers all rows of a frequent one.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = F.xxhash64("track_id", F.lit(seed))
    dealt = rows.withColumn("_part", F.pmod(drawn, F.lit(parts)))
    inside = Window.partitionBy("label", "_part").orderBy(drawn, "track_id")
    numbered = dealt.withColumn("_place", F.row_number().over(inside) - 1)
    sizes = dealt.groupBy(F.col("label").alias("_label"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_label").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_label", "_of", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    joined = numbered.join(before, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("fold", ((F.col("_place") + F.col("_before")) % k).cast("int")).drop("_part", "_place", "_label", "_of", "_before")


def balanced_accuracy(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean recall over the labels that occur, for each group."""
    recall = rows.groupBy(*by, "label").agg(F.avg((F.coalesce(F.col("prediction") == F.col("label"), F.lit(False))).cast("double")).alias("recall"))
    return recall.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def cross_validate(model, rows: DataFrame, k: int = 10, repeats: int = 3, seed: int = 42) -> DataFrame:
    """repeat and score, the mean balanced accuracy over the folds; every repeat shuffles anew.

    A model with ``predict_folds`` gets all folds of all repeats at once, columns fold0, fold1 ...; any other is fitted to one fold after the other.
    """
    draw = np.random.default_rng(seed)
    seeds = [int(draw.integers(1e9)) for _ in range(repeats)]
    if hasattr(model, "predict_folds"):
        dealt = rows.select(F.col("track_id").cast("long").alias("track_id"), F.col("features").cast("array<double>").alias("features"), "label")
        for r, s in enumerate(seeds):
            dealt = stratified_folds(dealt, k, s).withColumnRenamed("fold", f"fold{r}")
        dealt = dealt.withColumn("row", F.monotonically_increasing_id()).persist()
        dealt.count()  # numbers are given once
        tests = dealt.select("row", "label", F.posexplode(F.array(*(F.col(f"fold{r}") for r in range(repeats)))).alias("repeat", "fold"))
        scores = balanced_accuracy(tests.join(model.predict_folds(dealt, k, repeats), ["row", "repeat"], "left"), ("repeat", "fold"))
        return scores.groupBy("repeat").agg(F.avg("balanced_accuracy").cast("float").alias("score"))
    out = []
    for r, s in enumerate(seeds):
        folded = stratified_folds(rows, k, s).persist()
        for f in range(k):
            test = folded.where(F.col("fold") == f)
            found = model.fit_predict(folded.where(F.col("fold") != f), test)
            out.append(balanced_accuracy(test.join(found, "track_id", "left")).withColumns({"repeat": F.lit(r), "fold": F.lit(f)}))
    scores = reduce(DataFrame.unionByName, out)
    return scores.groupBy("repeat").agg(F.avg("balanced_accuracy").cast("float").alias("score"))


def score_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def mid_ranks(values: DataFrame) -> DataFrame:
    """``values`` (side, v) by value: how many of each side, and the middle of their ranks."""
    ties = values.groupBy("v").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 1).alias("n1"))
    return upto(ties, "v", "n", "rank").withColumn("rank", F.col("rank") - (F.col("n") - 1) / 2)


def exact_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) when all orders are equally likely, by counting."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    for j in range(1, n1 + n2 + 1):  # the j-th smallest may be of the first sample: then all of the second below it count
        for i in range(min(j, n1), 0, -1):
            below = j - i
            if 0 <= below <= n2:
                ways[i, below:] += ways[i - 1, : ways.shape[1] - below]
    total = ways[n1]
    return float(total[int(math.ceil(u)) :].sum() / total.sum())


def mann_whitney(first: DataFrame, second: DataFrame, column: str = "score") -> DataFrame:
    """u, p_value and better (p < 0.05) of the one-sided test that the first sample is larger.

    Exact for samples without ties of which one has at most 8 values; else the normal approximation with ties and continuity corrected.
    """
    both = first.select(F.lit(1).alias("side"), F.col(column).cast("double").alias("v")).unionAll(second.select(F.lit(2), F.col(column).cast("double"))).where("v is not null")
    about = mid_ranks(both).agg(F.sum("n1").alias("n1"), F.sum(F.col("n") - F.col("n1")).alias("n2"), F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum(F.col("n") * (F.col("n") * F.col("n") - 1)).alias("t")).first()
    n1, n2, ties = about.n1 or 0, about.n2 or 0, about.t or 0
    if not n1 or not n2:
        u, p = None, None
    else:
        u = about.r1 - n1 * (n1 + 1) / 2
        if not ties and min(n1, n2) <= 8 and max(n1, n2) <= 400:
            p = exact_tail(n1, n2, u)
        else:
            n = n1 + n2
            sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
            p = 0.5 * math.erfc((u - n1 * n2 / 2 - 0.5) / sd / math.sqrt(2)) if sd else 1.0
    return first.sparkSession.createDataFrame([(u, p, p is not None and p < 0.05)], "u double, p_value double, better boolean")
