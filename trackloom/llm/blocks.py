"""Pairs within groups, in blocks of bounded size: what the joins on near copies share.

A group of n members is cut into ceil(n / size) blocks by the hash of the member, and each pair of blocks is a piece of work of its own,
so no task holds more than two blocks of a group at once, whatever the group's size. A piece of work returns rows as many as its
members, never its pairs: for each member a sum, and one edge of a spanning forest of the links found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed

#: A key is hot if it has more rows than this, and than this share of all rows: at most so many keys can be hot.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def counts_of(rows: DataFrame, key: str) -> DataFrame:
    """key, n: the rows of each key, checkpointed."""
    return checkpointed(rows.groupBy(key).agg(F.count("*").alias("n")))


def dealt_join(rows: DataFrame, side: DataFrame, key: str | list[str], member: str, counts: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has one row for a key; ``counts``: (key, n) of all keys that may be hot, None if none can.

    Keys with more than ``HOT_ROWS`` rows and more than one in ``HOT_KEYS`` of all rows are dealt over as many parts as the largest of them
    fills of that size, by the hash of ``member``. As at most ``HOT_KEYS`` keys can be, their list is a constant of the plan; without one
    the join is a plain one. (Of several key columns the first tells which are hot.)
    """
    keys = [key] if isinstance(key, str) else key
    if counts is None:
        return rows.join(side, keys, how)
    about = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    part = max(HOT_ROWS, about["all"] // HOT_KEYS)
    if about["most"] <= part:
        return rows.join(side, keys, how)
    hot = F.coalesce(F.col(keys[0]).isin([r[0] for r in counts.where(F.col("n") > part).select(keys[0]).collect()]), F.lit(False))
    parts = -(-about["most"] // part)
    dealt = rows.withColumn("salt", F.when(hot, F.pmod(F.xxhash64(member), F.lit(parts)).cast("int")).otherwise(0))
    copies = side.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*keys, "salt"], how).drop("salt")


def sized(rows: DataFrame, key: str, member: str = "vertex") -> DataFrame:
    """``rows`` with n, the number of rows of the same key, for keys of two rows or more; no task gets all rows of a hot key."""
    counts = checkpointed(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"))
    return dealt_join(rows, counts, key, member, counts)


def block_pairs(rows: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """``rows`` (with n from ``sized``) as often as their group has blocks: with piece, the number of the pair of blocks, and side 0 or 1."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(77)), blocks).cast("int")
    cut = rows.withColumns({"blocks": blocks, "own": own})
    small, large = cut.where("blocks = 1"), cut.where("blocks > 1")
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    piece = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    large = large.withColumns({"piece": piece.cast("int"), "side": F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))}).drop("other")
    return small.withColumns({"piece": F.lit(0), "side": F.lit(-1)}).unionByName(large).drop("blocks", "own", "n")


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """Pieces of work kept together and in order within partitions."""
    parts = max(12, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, key, "piece").sortWithinPartitions(key, "piece")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 2, least: int = 2000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, offsets of groups): groups by the first ``keys`` columns, which come sorted, several at a time and each whole."""
    kept: list[pa.RecordBatch] = []
    held = 0

    def cut(t: pa.Table, last: bool) -> tuple[pa.Table | None, np.ndarray, pa.Table]:
        columns = [t.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        if last:
            return t, np.append(at, t.num_rows), t.slice(t.num_rows)
        return (t.slice(0, at[-1]), at, t.slice(at[-1])) if len(at) > 1 else (None, at, t)

    for batch in batches:
        kept.append(batch)
        held += batch.num_rows
        if held >= least:
            whole, at, rest = cut(pa.Table.from_batches(kept).combine_chunks(), False)
            if whole is not None:
                yield whole, at
            kept, held = rest.to_batches(), rest.num_rows
            least = max(2000, 2 * held)
    if held:
        whole, at, _ = cut(pa.Table.from_batches(kept).combine_chunks(), True)
        yield whole, at


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that links (a, b) reach, for each of n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def pairs_of(at: np.ndarray, side: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) of each group with offsets ``at``; where sides are 0 and 1, only pairs across. At most about ``most`` at a time."""
    left, right, held = [], [], 0
    n = np.diff(at)
    twos = at[:-1][n == 2]
    across = (side[twos] < 0) | (side[twos] != side[twos + 1]) if len(twos) else np.zeros(0, bool)
    for k in range(0, len(twos), most):
        t = twos[k : k + most][across[k : k + most]]
        if len(t):
            yield t, t + 1
    for first, size in zip(at[:-1][n > 2].tolist(), n[n > 2].tolist(), strict=True):
        s = side[first : first + size]
        if s[0] < 0:
            for i0 in range(0, size, max(1, most // size)):
                i, j = np.nonzero(np.arange(size)[None, :] > np.arange(i0, min(size, i0 + max(1, most // size)))[:, None])
                left.append(first + i0 + i)
                right.append(first + j)
                held += len(i)
                if held >= most:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, held = [], [], 0
        else:
            x, y = first + np.flatnonzero(s == 0), first + np.flatnonzero(s == 1)
            for i0 in range(0, len(x), max(1, most // max(1, len(y)))):
                part = x[i0 : i0 + max(1, most // max(1, len(y)))]
                left.append(np.repeat(part, len(y)))
                right.append(np.tile(y, len(part)))
                held += len(left[-1])
                if held >= most:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)
