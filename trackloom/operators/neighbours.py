"""Exact nearest neighbours by brute force, block against block, in NumPy.

Test rows are cut into blocks, and each block is one task that meets all training blocks one after another; a task holds two blocks at
once and returns the nearest rows of its test rows, so rows written grow with the test rows and never with the pairs. A product in single
precision with a bound of its error tells which pairs can be among the nearest; those pairs' distances are summed in double precision,
component by component, so the result is that of comparing all pairs in doubles.

As in the catalogue's SQL, a component that is missing on either side adds nothing, components beyond the test row's own are not looked
at, and a distance without any component is null; nulls come after NaN, and NaN after all numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

#: Rows of a training block, and of the tiles that are compared at once.
BLOCK, TILE, ACROSS = 8192, 1024, 4096


def matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, present): the lists as rows of doubles, shorter ones filled up with missing components."""
    lists = pa.concat_arrays([lists]).cast(pa.large_list(pa.float64()))
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten()
    width = int(size.max(initial=0))
    there = np.arange(width)[None, :] < size[:, None]
    x, has = np.zeros(there.shape), np.zeros(there.shape, bool)
    x[there] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    has[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    return x, has


def packed(rows: DataFrame, folds: int, parts: int, number: str) -> DataFrame:
    """``number`` and block (binary): rows (id, row, label, features, fold0 ...) dealt by hash into ``parts`` blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def block(of: int, t: pa.Table) -> tuple[int, bytes]:
            t = t.combine_chunks()
            ids = t.column(1)
            fold = np.stack([t.column(5 + i).to_numpy() for i in range(folds)]) if folds else np.zeros((0, t.num_rows), np.int64)
            x, has = matrix(t.column(4).chunk(0))
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            values = (ids.fill_null(np.iinfo(np.int64).max).to_numpy(), t.column(2).to_numpy(), t.column(3).to_pylist(), short if np.array_equal(short, x) else x, None if has.all() else has, fold.astype(np.int16))
            return of, pickle.dumps(values, 5)

        def out(blocks: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b[0] for b in blocks], pa.int32()), pa.array([b[1] for b in blocks], pa.binary())], names=[number, "block"])

        here = -1
        for batch in batches:
            part = batch.column(0).to_numpy()
            at = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if part[a] != here and kept:
                    yield out([block(here, pa.Table.from_batches(kept))])
                    kept.clear()
                here = int(part[a])
                kept.append(batch.slice(a, b - a))
        if kept:
            yield out([block(here, pa.Table.from_batches(kept))])

    dealt = rows.select(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(parts)).cast("int").alias("_of"), "id", "row", "label", "features", *(f"fold{i}" for i in range(folds)))
    return dealt.repartition(parts, "_of").sortWithinPartitions("_of").mapInArrow(run, f"{number} int, block binary")


def unpacked(block: pa.Scalar) -> tuple:
    """(ids, rows, labels, values, present, folds) of a block."""
    ids, row, labels, x, has, fold = pickle.loads(block.as_buffer())
    return ids, row, labels, x.astype(float), np.ones(x.shape, bool) if has is None else has, fold


class Kept:
    """The k nearest so far of each test row: its place, distance and kind (0 a number, 1 NaN, 2 null), and the training row's id and label."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.far = k, np.full(n, np.inf)
        self.row, self.kind, self.d, self.id, self.label = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, row: np.ndarray, kind: np.ndarray, d: np.ndarray, id_: np.ndarray, label: np.ndarray) -> None:
        if not len(row):
            return
        row, kind, d, id_, label = (np.concatenate(x) for x in zip((self.row, self.kind, self.d, self.id, self.label), (row, kind, d, id_, label), strict=True))
        order = np.lexsort((id_, d, kind, row))
        r = row[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        near = order[place < self.k]
        last = order[place == self.k - 1]
        self.row, self.kind, self.d, self.id, self.label = row[near], kind[near], d[near], id_[near], label[near]
        self.far[row[last]] = np.where(kind[last] == 0, d[last], np.inf)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the columns of x and y, summed one component after the other."""
    s = np.zeros(x.shape[1])
    for a, b in zip(x, y, strict=True):
        s += (a - b) * (a - b)
    return np.sqrt(s)


def meet(kept: list[Kept], test: tuple, train: tuple) -> None:
    """All rows of a test block against all of a training block; with folds, a row meets only rows of other folds."""
    _, _, _, x, has_x, fold_x = test
    ids, _, labels, y, has_y, fold_y = train
    names = np.empty(len(labels), object)
    names[:] = labels
    width = max(x.shape[1], y.shape[1])
    x, has_x, y, has_y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, has_x, y, has_y))
    plain = lambda v, has: has.all(1) & (np.abs(v).max(1, initial=0) < 1e15)
    a, b = np.flatnonzero(plain(x, has_x)), np.flatnonzero(plain(y, has_y))
    if width:
        compare(kept, x[a], y[b], a, b, ids, names, fold_x, fold_y)
    else:
        a = b = a[:0]
    odd_x, odd_y = np.setdiff1d(np.arange(len(x)), a), np.setdiff1d(np.arange(len(y)), b)
    for rows, others in ((odd_x, np.arange(len(y))), (a, odd_y)):
        for r in np.array_split(rows, max(1, len(rows) * len(others) // (TILE * ACROSS) + 1)):
            if not len(r) or not len(others):
                continue
            s, any_ = np.zeros((len(r), len(others))), np.zeros((len(r), len(others)), bool)
            for c in range(width):
                both = has_x[r, c][:, None] & has_y[others, c][None, :]
                with np.errstate(invalid="ignore", over="ignore"):
                    gap = x[r, c][:, None] - y[others, c][None, :]
                    s += np.where(both, gap * gap, 0)
                any_ |= both
            kind = np.where(any_, np.isnan(s), 2).astype(np.int8)
            d = np.sqrt(np.where(kind == 0, s, 0))
            i, j = np.nonzero(np.ones_like(any_))
            for f, k in enumerate(kept):
                use = fold_x[f][r[i]] != fold_y[f][others[j]] if len(fold_x) else slice(None)
                p, q = i[use], j[use]
                k.add(r[p], kind[p, q], d[p, q], ids[others[q]], names[others[q]])


def compare(kept: list[Kept], x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, names: np.ndarray, fold_x: np.ndarray, fold_y: np.ndarray) -> None:
    if not len(x) or not len(y):
        return
    xs, ys, xt, yt = x.astype(np.float32), y.astype(np.float32), np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    with np.errstate(over="ignore"):
        nx, ny = (x * x).sum(1), (y * y).sum(1)
    # The bound of what single precision can be off: two roundings of each value, and of every step of the sum.
    slack = (np.sqrt(nx) + np.sqrt(ny.max())) ** 2 * (4 * (x.shape[1] + 16) * 6e-8)
    for i0 in range(0, len(x), TILE):
        i1 = min(len(x), i0 + TILE)
        for j0 in range(0, len(y), ACROSS):
            j1 = min(len(y), j0 + ACROSS)
            about = xs[i0:i1] @ ys[j0:j1].T
            about *= -2
            about += nx[i0:i1, None].astype(np.float32)
            about += ny[None, j0:j1].astype(np.float32)
            for f, held in enumerate(kept):
                far = held.far[a[i0:i1]] ** 2 * (1 + 1e-12) + slack[i0:i1]
                new = np.flatnonzero(np.isinf(far))
                if len(new) and j1 - j0 > held.k:
                    first = about[new]
                    if len(fold_x):
                        first = np.where(fold_x[f][a[i0 + new]][:, None] == fold_y[f][b[j0:j1]][None, :], np.float32(np.inf), first)
                    far[new] = np.partition(first, held.k - 1, 1)[:, held.k - 1].astype(float) + 2 * slack[i0 + new]
                i, j = np.nonzero(about <= np.nextafter(far.astype(np.float32), np.float32(np.inf))[:, None])
                if len(fold_x):
                    other = fold_x[f][a[i0 + i]] != fold_y[f][b[j0 + j]]
                    i, j = i[other], j[other]
                d = np.concatenate([distances(xt[:, i0 + i[s : s + 200_000]], yt[:, j0 + j[s : s + 200_000]]) for s in range(0, max(1, len(i)), 200_000)])
                held.add(a[i0 + i], np.zeros(len(i), np.int8), d, ids[b[j0 + j]], names[b[j0 + j]])


def nearest_rows(train: DataFrame, test: DataFrame, k: int, folds: int = 0) -> DataFrame:
    """row, repeat, near_id, near_label and d: the k nearest training rows of every test row; ties go to the smaller id.

    ``test`` has row (long), ``train`` and ``test`` id (long), label and features (array<double>), and with ``folds`` columns fold0, fold1 ...: each is a
    search of its own, among the rows of other folds.
    """
    spark = train.sparkSession
    kind = train.schema["label"].dataType
    cores = spark.sparkContext.defaultParallelism
    n, m = train.count(), test.count()
    blocks = packed(train, folds, max(1, -(-n // BLOCK)), "s")
    tests = max(-(-m // BLOCK), min(max(1, m // 64), 2 * cores))
    work = packed(test, folds, tests, "t").select("t", F.lit(-1).alias("s"), "block")
    work = work.unionByName(blocks.crossJoin(F.broadcast(spark.range(tests).select(F.col("id").cast("int").alias("t")))).select("t", "s", "block"))
    typed = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block, kept = -1, None, []

        def done() -> Iterator[pa.RecordBatch]:
            for r, held in enumerate(kept):
                d = np.where(held.kind == 1, np.nan, held.d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[1][held.row]), pa.array(np.full(len(d), r, np.int32)), pa.array(held.id), pa.array(held.label.tolist(), typed), pa.array(d, mask=held.kind == 2)],
                    names=["row", "repeat", "near_id", "near_label", "d"],
                )

        for batch in batches:
            for t, s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                got = unpacked(b)
                if s < 0:
                    if kept:
                        yield from done()
                    here, block, kept = t, got, [Kept(len(got[0]), k) for _ in range(max(1, folds))]
                elif t == here:
                    meet(kept, block, got)
        if kept:
            yield from done()

    schema = StructType([StructField("row", LongType()), StructField("repeat", IntegerType()), StructField("near_id", LongType()), StructField("near_label", kind), StructField("d", DoubleType())])
    return work.repartitionByRange(tests, "t").sortWithinPartitions("t", "s").mapInArrow(run, schema)
