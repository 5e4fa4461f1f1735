"""Models for all folds of all repeats at once.

Rows are packed into blocks (``neighbours.packed``). Machines are fitted together: every step is one job in which each partition adds up the
losses and gradients of all fits over its blocks, and the driver moves each fit by L-BFGS. Trees and perceptrons are dealt to tasks in one
job: a task gets all blocks once, grows or fits its share one after another, and returns the predictions alone. Perceptrons on more rows
than a task should hold (``HELD``) are fitted step by step like machines. All rows of a fit take part; a row's own fold is predicted by the
fit without it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import packed, unpacked

FOUND = "row long, repeat int, code int"

#: Bytes of values (4 a component) up to which a task holds all rows of its perceptrons, and the columns that go through the layers at once.
HELD, TILE = 64 << 20, 1024


class Blocks:
    """The blocks of ``rows`` (row, track_id, label, features, fold0 ...) in memory, the labels' codes and the fits (repeat, fold)."""

    def __init__(self, rows: DataFrame, fits: list[tuple[int, int]], repeats: int) -> None:
        spark = rows.sparkSession
        self.context, self.fits, self.kind = spark.sparkContext, fits, rows.schema["label"].dataType
        self.names = sorted(r[0] for r in rows.where("label is not null").select("label").distinct().collect())
        self.codes = {v: i for i, v in enumerate(self.names)}
        self.width = rows.agg(F.max(F.size("features"))).first()[0] or 0
        self.n = rows.count()
        parts = max(-(-self.n // 2048), min(max(1, self.n // 256), self.context.defaultParallelism))
        self.table = packed(rows.withColumnRenamed("track_id", "id"), repeats, parts, "part").select("block").persist()
        self.data = self.table.rdd.map(lambda r: bytes(r[0])).coalesce(self.context.defaultParallelism)  # each partition sends its sums to the driver

    def reader(self) -> Callable[[bytes], tuple]:
        """row, values, code (-1: no label) and folds of the rows that have all components, finite."""
        codes, width = self.codes, self.width

        def read(block: bytes) -> tuple:
            import pyarrow as pa

            _, row, labels, x, has, fold = unpacked(pa.scalar(block))
            good = has.all(1) & np.isfinite(x).all(1) if x.shape[1] == width else np.zeros(len(x), bool)
            return row[good], x[good] if x.shape[1] == width else np.zeros((0, width)), np.array([codes.get(v, -1) for v in labels], np.int64)[good], fold[:, good]

        return read

    def summed(self, step: Callable[..., tuple], shared: object) -> list[np.ndarray]:
        """The sums, over all blocks, of the arrays that ``step`` (shared, row, x, code, fold) gives."""
        sent, read = self.context.broadcast(shared), self.reader()

        def run(blocks: Iterator[bytes]) -> Iterator[list[np.ndarray]]:
            total = None
            for b in blocks:
                found = step(sent.value, *read(b))
                total = [np.array(v, float) for v in found] if total is None else [t + v for t, v in zip(total, found, strict=True)]
            if total is not None:
                yield total

        try:
            total = None
            for found in self.data.mapPartitions(run).collect():
                total = found if total is None else [t + v for t, v in zip(total, found, strict=True)]
            return total
        finally:
            sent.destroy()

    def predicted(self, predict: Callable[..., np.ndarray], shared: object) -> DataFrame:
        """row, repeat and code; ``predict`` (shared, fit, x) gives the codes of rows by a fit."""
        sent, read, fits = self.context.broadcast(shared), self.reader(), self.fits

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for b in batch["block"]:
                    row, x, _, fold = read(b)
                    for m, (r, f) in enumerate(fits):
                        own = fold[r] == f
                        yield pd.DataFrame({"row": row[own], "repeat": np.full(own.sum(), r, np.int32), "code": predict(sent.value, m, x[own]).astype(np.int32)})

        return self.table.mapInPandas(run, FOUND)

    def shared_out(self, work: Callable[..., Iterator[pd.DataFrame]], short: Callable[..., tuple]) -> DataFrame:
        """row, repeat and code in one job: ``work`` (its fits, the blocks read and made ``short``) runs in tasks that get all blocks once."""
        fits, read = self.fits, self.reader()
        tasks = min(len(fits), self.context.defaultParallelism)
        numbers = self.table.sparkSession.range(tasks).select(F.col("id").cast("int").alias("t"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            here, held = -1, []
            for batch in batches:
                for t, b in zip(batch["t"], batch["block"], strict=True):
                    if t != here and held:
                        yield from work(fits[here::tasks], held)
                        held = []
                    here = t
                    held.append(short(*read(b)))
            if held:
                yield from work(fits[here::tasks], held)

        return self.table.crossJoin(F.broadcast(numbers)).repartitionByRange(tasks, "t").sortWithinPartitions("t").mapInPandas(run, FOUND)


def joined(held: list[tuple], width: int) -> tuple[np.ndarray, ...]:
    """row, values by feature, code and folds of all blocks ``held``, which is emptied."""
    row, code, fold = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held], 1)
    x = np.empty((width, len(row)), np.result_type(*(h[1] for h in held)))
    end = 0
    while held:
        part = held.pop(0)[1]
        x[:, end : end + len(part)] = part.T
        end += len(part)
    return row, x, code, fold


def in_fit(fits: list[tuple[int, int]], code: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """(fits, rows): 1 where a fit learns from a row."""
    return np.stack([(fold[r] != f) & (code >= 0) for r, f in fits]).astype(float)


def lbfgs(value: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, steps: int, tolerance: float = 1e-6, memory: int = 10) -> np.ndarray:
    """Minima of many functions side by side: ``value`` (points) gives all values and gradients. Each halves its step until it goes down enough."""
    w = start.copy()
    f, g = value(w)
    n = len(w)
    first = np.abs(f)
    active, taken, history = np.ones(n, bool), np.zeros(n, int), [[v] for v in f]
    rows = np.arange(n)
    s_, y_, rho = np.zeros((memory, n, w.shape[1])), np.zeros((memory, n, w.shape[1])), np.zeros((memory, n))
    head = np.zeros(n, int)

    def direction(g: np.ndarray) -> np.ndarray:
        q, alpha = g.copy(), np.zeros((memory, n))
        for back in range(1, memory + 1):
            k = (head - back) % memory
            a = rho[k, rows] * np.einsum("ij,ij->i", s_[k, rows], q)
            alpha[k, rows] = a
            q -= a[:, None] * y_[k, rows]
        k = (head - 1) % memory
        yy = np.einsum("ij,ij->i", y_[k, rows], y_[k, rows])
        scale = np.where(rho[k, rows] > 0, 1 / np.maximum(rho[k, rows] * yy, 1e-300), 1 / np.maximum(np.linalg.norm(g, axis=1), 1e-300))
        q *= scale[:, None]
        for back in range(memory, 0, -1):
            k = (head - back) % memory
            q += (alpha[k, rows] - rho[k, rows] * np.einsum("ij,ij->i", y_[k, rows], q))[:, None] * s_[k, rows]
        return -q

    d, t = direction(g), np.ones(n)
    while active.any():
        slope = np.einsum("ij,ij->i", d, g)
        up = slope >= 0
        d[up], slope[up] = -g[up], -np.einsum("ij,ij->i", g[up], g[up])
        trial = np.where(active[:, None], w + t[:, None] * d, w)
        ft, gt = value(trial)
        good = active & (ft <= f + 1e-4 * t * slope)
        if good.any():
            s, y = (trial - w)[good], (gt - g)[good]
            sy = np.einsum("ij,ij->i", s, y)
            bend = sy > 1e-12 * np.einsum("ij,ij->i", y, y)
            at = np.flatnonzero(good)[bend]
            s_[head[at], at], y_[head[at], at], rho[head[at], at] = s[bend], y[bend], 1 / sy[bend]
            head[at] = (head[at] + 1) % memory
            w[good], g[good] = trial[good], gt[good]
            f = np.where(good, ft, f)
            taken[good] += 1
            for i in np.flatnonzero(good).tolist():
                history[i] = [*history[i][-10:], f[i]]
                flat = len(history[i]) > 10 and history[i][0] - f[i] <= tolerance * max(first[i], 1e-300)
                active[i] = taken[i] < steps and not flat and np.abs(g[i]).max() > tolerance * 1e-2
            d = np.where(good[:, None], direction(g), d)
        t = np.where(good, 1.0, t / 2)
        active &= t > 1e-6  # no way down along this line
    return w


def machines(blocks: Blocks, size: int, cost: float, seed: int) -> DataFrame:
    """Machines with a radial kernel by random Fourier features: one linear machine a class and fit, hinge loss, 15 steps, standardised features."""
    fits, classes, width = blocks.fits, len(blocks.names), blocks.width
    r = np.random.default_rng(seed)
    lines, phases = r.normal(size=(width, size)), r.uniform(0, 2 * np.pi, size)
    n, s1, s2 = blocks.summed(lambda _, row, x, code, fold: ((u := in_fit(fits, code, fold)).sum(1), u @ x.sum(1), u @ (x * x).sum(1)), None)
    count = np.maximum(n * width, 1)
    var = s2 / count - (s1 / count) ** 2
    gamma = np.where(var > 0, 1 / np.where(var > 0, width * var, 1), 1.0)

    def waves(x: np.ndarray, m: int, base: np.ndarray | None = None) -> np.ndarray:
        z = (x @ lines if base is None else base) * math.sqrt(2 * gamma[m]) + phases
        return math.sqrt(2 / size) * np.cos((z - 2 * np.pi * np.round(z / (2 * np.pi))).astype(np.float32))

    def spread(_, row, x, code, fold):
        u, base = in_fit(fits, code, fold), x @ lines
        z = [waves(x, m, base) for m in range(len(fits))]
        return np.stack([a @ b for a, b in zip(u, z, strict=True)]), np.stack([a @ (b * b) for a, b in zip(u, z, strict=True)])

    z1, z2 = blocks.summed(spread, None)
    of = np.maximum(n, 1)[:, None]
    std = np.sqrt(np.maximum(z2 / of - (z1 / of) ** 2, 0) * of / np.maximum(of - 1, 1))
    inverse = np.where(std > 1e-12, 1 / np.where(std > 1e-12, std, 1), 0)

    def hinge(w, row, x, code, fold):
        u, base = in_fit(fits, code, fold), x @ lines
        side = np.where(code[:, None] == np.arange(classes)[None, :], 1.0, -1.0)
        loss, slope = np.zeros((len(fits), classes)), np.zeros((len(fits), classes, size + 1))
        for m in range(len(fits)):
            z = waves(x, m, base)
            gap = np.maximum(1 - side * (z @ (w[m, :, :-1] * inverse[m]).T.astype(np.float32) + w[m, :, -1]), 0) * u[m][:, None]
            loss[m] = gap.sum(0)
            against = ((gap > 0) * side).astype(np.float32)
            slope[m, :, :-1] = -(against.T @ z) * inverse[m]
            slope[m, :, -1] = -against.sum(0)
        return loss, slope

    penalty = 1 / (cost * np.maximum(n, 1))

    def value(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = w.reshape(len(fits), classes, size + 1)
        loss, slope = blocks.summed(hinge, w)
        loss, slope = loss / of, slope / of[:, :, None]
        loss += penalty[:, None] / 2 * (w[:, :, :-1] ** 2).sum(2)
        slope[:, :, :-1] += penalty[:, None, None] * w[:, :, :-1]
        return loss.ravel(), slope.reshape(-1, size + 1)

    w = lbfgs(value, np.zeros((len(fits) * classes, size + 1)), 15).reshape(len(fits), classes, size + 1)
    return blocks.predicted(lambda w, m, x: (np.column_stack((waves(x, m) * inverse[m], np.ones(len(x)))) @ w[m].T).argmax(1), w)


def layers(w: np.ndarray, shape: list[int]) -> list[np.ndarray]:
    """The weights of each layer, (inputs + 1, outputs), the last row for the bias; views of ``w``."""
    out, end = [], 0
    for a, b in zip(shape[:-1], shape[1:], strict=True):
        out.append(w[end : end + (a + 1) * b].reshape(a + 1, b))
        end += (a + 1) * b
    return out


def forward(held: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """``x`` (features, rows) and what each layer gives: sigmoids, the last layer as it is."""
    out = [x]
    for i, a in enumerate(held):
        z = a[:-1].T @ out[-1]
        z += a[-1][:, None]
        if i < len(held) - 1:
            np.negative(z, out=z)
            with np.errstate(over="ignore"):  # then the sigmoid is 0
                np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
        out.append(z)
    return out


def entropy(w: np.ndarray, shape: list[int], x: np.ndarray, code: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed loss of one perceptron on ``x`` (features, rows) with known codes, and its gradient."""
    held, loss, slope = layers(w.astype(np.float32), shape), 0.0, np.zeros(len(w))
    sums = layers(slope, shape)
    for a in range(0, len(code), TILE):
        out = forward(held, x[:, a : a + TILE])
        z = out[-1] - out[-1].max(0)
        at = code[a : a + TILE], np.arange(z.shape[1])
        delta = np.exp(z)
        total = delta.sum(0)
        loss += (np.log(total) - z[at]).sum(dtype=float)
        delta /= total
        delta[at] -= 1
        ones = np.ones(len(total), np.float32)
        for i in range(len(held) - 1, -1, -1):
            sums[i][:-1] += out[i] @ delta.T
            sums[i][-1] += delta @ ones
            if i:
                delta = held[i][:-1] @ delta
                delta *= out[i]
                delta *= np.subtract(1, out[i], out=out[i])
    return loss, slope


def perceptrons(blocks: Blocks, hidden: tuple[int, ...], steps: int, seed: int) -> DataFrame:
    """Sigmoid layers and a softmax, without early stopping or a penalty on weights."""
    fits, width, shape = blocks.fits, blocks.width, [blocks.width, *hidden, max(2, len(blocks.names))]
    r = np.random.default_rng(seed)
    start = np.concatenate([r.uniform(-2.4, 2.4, (a + 1) * b) / max(1, a) for a, b in zip(shape[:-1], shape[1:], strict=True)])

    def said(w: np.ndarray, x: np.ndarray) -> np.ndarray:
        held = layers(w.astype(np.float32), shape)
        return np.concatenate([np.zeros(0, int), *(forward(held, x[:, a : a + TILE])[-1].argmax(0) for a in range(0, x.shape[1], TILE))])

    def short(row: np.ndarray, x: np.ndarray, code: np.ndarray, fold: np.ndarray) -> tuple:
        with np.errstate(over="ignore"):
            return row, x.astype(np.float32), code, fold

    def fitted(share: list[tuple[int, int]], held: list[tuple]) -> Iterator[pd.DataFrame]:
        row, x, code, fold = joined(held, width)
        order = np.argsort(row)  # blocks come in any order, and sums that round otherwise end elsewhere after many steps
        for r, f in share:
            asked = fold[r] == f
            if asked.any():
                learns = order[(~asked & (code >= 0))[order]]
                mine, codes = x[:, learns], code[learns]

                def value(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    loss, slope = entropy(w[0], shape, mine, codes)  # noqa: B023
                    return np.array([loss]) / max(1, len(codes)), slope[None, :] / max(1, len(codes))  # noqa: B023

                found = said(lbfgs(value, start[None, :], steps)[0], x[:, asked])
                yield pd.DataFrame({"row": row[asked], "repeat": np.full(len(found), r, np.int32), "code": found.astype(np.int32)})

    if blocks.n * width * 4 <= HELD:
        return blocks.shared_out(fitted, short)

    def summed(w: np.ndarray, row: np.ndarray, x: np.ndarray, code: np.ndarray, fold: np.ndarray) -> tuple:
        x, u = np.ascontiguousarray(short(row, x, code, fold)[1].T), in_fit(fits, code, fold) > 0
        found = [entropy(a, shape, x[:, b], code[b]) for a, b in zip(w, u, strict=True)]
        return np.array([f[0] for f in found]), np.stack([f[1] for f in found])

    (n,) = blocks.summed(lambda _, row, x, code, fold: (in_fit(fits, code, fold).sum(1),), None)
    n = np.maximum(n, 1)

    def value(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss, slope = blocks.summed(summed, w.astype(np.float32))
        return loss / n, slope / n[:, None]

    w = lbfgs(value, np.tile(start, (len(fits), 1)), steps).astype(np.float32)
    return blocks.predicted(lambda w, m, x: said(w[m], np.ascontiguousarray(x.T, np.float32)), w)


def splits(x: np.ndarray, orders: np.ndarray, code: np.ndarray, node: np.ndarray, nodes: int, whose: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature and threshold of each node's purest split (Gini), among all between two different values; feature -1: its rows are all alike.

    ``orders`` sorts each row of ``x`` (features, rows), ``node`` is ``nodes`` for rows that are not learnt from, ``runs`` has how many rows a class
    has in node ``whose``, by class, then node. Ties go to the first feature and the smallest value. All sums of squares are whole numbers, exact
    up to 9e7 rows.
    """
    size, total = np.bincount(whose, runs, nodes).astype(np.int64), np.bincount(whose, runs.astype(float) ** 2, nodes)
    starts, m = np.cumsum(size) - size, int(size.sum())
    place = np.arange(m) - np.repeat(np.cumsum(runs) - runs, runs)  # in the order of runs, rows of a class and node count up, whatever the feature
    joins, leaves = 2.0 * place + 1, 2.0 * (np.repeat(runs, runs) - place) - 1
    of = np.repeat(np.arange(nodes), size)
    before, after = (np.cumsum(total) - total)[of], np.cumsum(total)[of]
    left = np.arange(1.0, m + 1) - starts[of]
    right = np.maximum(size[of] - left, 1)
    inside = left[:-1] < size[of[:-1]]
    key = node.astype(np.min_scalar_type(nodes))  # short keys are sorted by digits
    best, feature, threshold = np.full(nodes, -1.0), np.full(nodes, -1), np.zeros(nodes)
    a, b = np.empty(m), np.empty(m)
    for j, order in enumerate(orders):
        rows = order[np.argsort(key[order], kind="stable")[:m]]  # by node, then value
        by_class = np.argsort(code[rows], kind="stable")
        a[by_class], b[by_class] = joins, leaves
        pure = (np.cumsum(a) - before) / left + (after - np.cumsum(b)) / right
        v = x[j][rows]
        pure[:-1][~(inside & (v[:-1] < v[1:]))] = -1
        pure[-1:] = -1
        found = np.maximum.reduceat(pure, starts)
        better = found > best
        if better.any():
            at = np.flatnonzero(pure == np.where(better, found, -2)[of])
            at = at[np.concatenate(([True], of[at[1:]] != of[at[:-1]]))]
            low, high = v[at].astype(float), v[at + 1].astype(float)
            middle = low / 2 + high / 2
            best[better], feature[better], threshold[better] = found[better], j, np.where(middle < high, np.maximum(middle, low), low)
    return feature, threshold


def tree(x: np.ndarray, orders: np.ndarray, code: np.ndarray, learns: np.ndarray, asked: np.ndarray, depth: int) -> np.ndarray:
    """The codes that a tree grown on the rows ``learns`` gives to the rows ``asked``, -1 to others; a leaf says its most frequent label, the first of equals."""
    said, at = np.full(len(code), -1), np.where(learns | asked, 0, -1)
    short = code.astype(np.min_scalar_type(code.max(initial=0)))
    n = 1
    for level in range(depth + 1):
        rows = np.flatnonzero(learns & (at >= 0))
        pairs, runs = np.unique(code[rows] * n + at[rows], return_counts=True)
        label, whose = pairs // n, pairs % n
        leads = np.lexsort((label, -runs, whose))[::-1]  # a node's most frequent label is set last
        most = np.full(n, -1)
        most[whose[leads]] = label[leads]
        here = np.flatnonzero(at >= 0)
        said[here] = most[at[here]]
        mixed = np.bincount(whose, minlength=n) > 1
        if level == depth or not mixed.any():
            break
        number, nodes = np.where(mixed, np.cumsum(mixed) - 1, -1), int(mixed.sum())
        at[here] = number[at[here]]
        feature, threshold = splits(x, orders, short, np.where(learns & (at >= 0), at, nodes), nodes, number[whose[mixed[whose]]], runs[mixed[whose]])
        here = np.flatnonzero(at >= 0)
        to, f = at[here], feature[at[here]]
        at[here] = np.where(f < 0, -1, 2 * to + (x[np.maximum(f, 0), here] > threshold[to]))
        n = 2 * nodes
    return np.where(asked, said, -1)


def trees(blocks: Blocks, depth: int) -> DataFrame:
    """Trees of at most ``depth`` splits in a row: nodes are split while labels differ, at the purest of all thresholds (no bins, no sample of values).

    A task holds the rows twice, as values by feature and as their orders, and its fits one after another.
    """
    width = blocks.width

    def grown(share: list[tuple[int, int]], held: list[tuple]) -> Iterator[pd.DataFrame]:
        row, x, code, fold = joined(held, width)
        orders = np.empty(x.shape, np.int32 if len(row) < 2**31 else np.int64)
        for j in range(width):
            orders[j] = np.argsort(x[j])
        for r, f in share:
            asked = fold[r] == f
            if asked.any():
                found = tree(x, orders, code, ~asked & (code >= 0), asked, depth)[asked]
                yield pd.DataFrame({"row": row[asked], "repeat": np.full(len(found), r, np.int32), "code": found.astype(np.int32)})

    def short(row: np.ndarray, x: np.ndarray, code: np.ndarray, fold: np.ndarray) -> tuple:
        with np.errstate(over="ignore"):
            single = x.astype(np.float32)
        return row, single if np.array_equal(single, x) else x, code, fold

    return blocks.shared_out(grown, short)
