"""Near-duplicate vectors by cross-polytope hashing (Andoni et al., 2015).

A vector, padded with zeros to the power of two that holds the table's longest one, is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the
signed axis it lies closest to. ``width`` such hashes make a bucket of a table. Multiprobe: in each of ``tables`` tables a vector is put
into the ``probes`` buckets that cost it least, the loss of a bucket being how much shorter its axes' coordinates are than the best. At
cosine 0.98 in 64 dimensions the defaults miss a pair with probability below 1e-4 (simulated), and a link is lost only if its whole
component falls apart. Pairs in a bucket are verified by their cosine in double precision; buckets of any size are compared in blocks.
Then each component of verified links is compared again within itself, in blocks, which counts all its links.

Only vectors with the same label, not null and of whatever type (known by a 64-bit hash), are compared. Equal vectors of a label (trailing
zeros aside, by a 128-bit hash) are one vertex with a number of copies, and copies count as links. Vectors are scaled by their largest
component before their length is taken, so very small and very large ones have their true cosines. Rows without an id link like others; a
component of such rows alone has none as its component_id. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do those without a label:
they are components of their own. Rows with equal ids count as copies if their vectors agree; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, mix, signed, slice_digests
from .blocks import block_pairs, counts_of, dealt_join, forest, gathered, sized, whole_groups
from .components import connected_components


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dimensions) in double precision, shorter vectors padded with zeros; and which rows are neither null, zero nor hold null or non-finite components."""
    column = column.cast(pa.list_(pa.float64()))
    n = len(column)
    upto, flat = column.offsets.to_numpy().astype(np.int64), column.values
    good = ~np.asarray(column.is_null()) if n else np.zeros(0, bool)
    bad = np.asarray(flat.is_null())
    x = np.where(bad, np.nan, np.asarray(flat.fill_null(0.0)))
    length = np.where(good, np.diff(upto), 0)
    out = np.zeros((n, max(1, int(length.max(initial=0)))))
    for size in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == size)
        out[rows, :size] = x[upto[rows][:, None] + np.arange(size)]
    fine = np.isfinite(out).all(1)
    out[~fine] = 0
    return out, good & fine & (out != 0).any(1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows are scaled by their largest component first, so that no square under- or overflows."""
    x = x / np.maximum(np.abs(x).max(1, initial=0, keepdims=True), 5e-324)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def buckets(x: np.ndarray, size: int, tables: int, width: int, probes: int) -> np.ndarray:
    """(rows, tables * probes) bucket names in ``size`` dimensions, a power of two; for each table those of least loss first."""
    n, d = x.shape
    padded = np.zeros((n, size))
    padded[:, :d] = unit(x)
    choices = list(itertools.product(range(min(3, size)), repeat=width))
    out = np.empty((n, tables, probes), np.uint64)
    for t in range(tables):
        loss, name = np.zeros((n, len(choices))), np.full((n, len(choices)), t + 1, np.uint64)
        for k in range(width):
            y, random = padded, np.random.default_rng(1_000 * t + k)
            for _ in range(3):
                y = hadamard(y * random.choice([-1.0, 1.0], size))
            order = np.argsort(-np.abs(y), 1, kind="stable")[:, :3]
            best = np.take_along_axis(y, order, 1)
            axis = (2 * order + (best > 0)).astype(np.uint64)
            pick = np.array([c[k] for c in choices])
            loss += np.abs(best[:, :1]) - np.abs(best[:, pick])
            with np.errstate(over="ignore"):
                name = mix(name * np.uint64(0x9E3779B97F4A7C15) + axis[:, pick])
        out[:, t] = np.take_along_axis(name, np.argsort(loss, 1, kind="stable")[:, :probes], 1)
    return out.reshape(n, -1)


def trimmed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of rows without trailing zeros, and where each row starts and ends."""
    x = np.ascontiguousarray(x + 0.0)  # one zero only
    width = x.shape[1]
    length = width - np.argmax(x[:, ::-1] != 0, 1)
    starts = np.arange(len(x)) * 8 * width
    return x.view(np.uint8).ravel(), starts, starts + 8 * length


def hashed(table: DataFrame, size: int, tables: int, width: int, probes: int) -> DataFrame:
    """vec_id, label, two halves of the vector's name (null for vectors that take no part), embedding and the names of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                x, good = vectors(part.column(1))
                label = part.column(2)
                good &= ~np.asarray(label.is_null())
                y = np.asarray(label.fill_null(0)).view(np.uint64)
                names = slice_digests(*trimmed(x))
                with np.errstate(over="ignore"):
                    into = mix(buckets(x, size, tables, width, probes) + mix(y + np.uint64(7))[:, None])
                lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel(), kind))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), label, *(pa.array(signed(h), mask=~good) for h in names), lists(x, pa.float64()), lists(signed(into), pa.int64())],
                    names=["vec_id", "label", "h0", "h1", "embedding", "buckets"],
                )

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label"))
    return rows.mapInArrow(run, "vec_id long, label long, h0 long, h1 long, embedding array<double>, buckets array<long>")


def linked(work: DataFrame, least: float) -> DataFrame:
    """vertex, links (copies of vertices linked to it) and root (the end of a forest edge), for work with key, piece, side, vertex, copies, embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches):
            side, vertex, copies = (rows.column(i).to_numpy() for i in (2, 3, 4))
            x = unit(vectors(rows.column(5).combine_chunks())[0])
            links = np.zeros(len(vertex), np.int64)
            size = np.diff(at)
            ends = [np.zeros(0, np.int64)] * 2
            tiny = np.flatnonzero(size <= 8)
            for i, j in pairs_in(at, tiny, side):
                near = (np.einsum("ij,ij->i", x[i], x[j]) >= least) & (vertex[i] != vertex[j])
                np.add.at(links, i[near], copies[j[near]])
                np.add.at(links, j[near], copies[i[near]])
                ends = [np.concatenate((ends[0], i[near])), np.concatenate((ends[1], j[near]))]
            root = forest(len(vertex), *ends)
            for g in np.flatnonzero(size > 8).tolist():
                mine = slice(at[g], at[g + 1])
                near = x[mine] @ x[mine].T >= least
                near &= vertex[mine][:, None] != vertex[mine][None, :]
                if side[at[g]] >= 0:
                    near &= side[mine][:, None] != side[mine][None, :]
                links[mine] = near @ copies[mine]
                root[mine] = at[g] + forest(near.shape[0], *np.nonzero(near))
            yield pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(links), pa.array(vertex[root])], names=["vertex", "links", "root"])

    return work.mapInArrow(run, "vertex long, links long, root long")


def pairs_in(at: np.ndarray, groups: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the small groups named, by position in the rows."""
    size = np.diff(at)[groups]
    for n in np.unique(size[size > 1]).tolist():
        first = at[groups[size == n]]
        a, b = np.triu_indices(n, 1)
        for k in range(0, len(first), 20_000 // len(a)):
            i, j = (first[k : k + 20_000 // len(a), None] + v for v in (a, b))
            i, j = i.ravel(), j.ravel()
            across = (side[i] < 0) | (side[i] != side[j])
            yield i[across], j[across]


def near_vectors(table: DataFrame, least: float = 0.98, tables: int = 4, width: int = 3, probes: int = 4, block: int = 400) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    longest = table.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first().d
    drawn = checkpointed(hashed(table, 1 << max(1, (longest - 1).bit_length()), tables, width, probes))
    key = ["label", "h0", "h1"]
    vertices = checkpointed(
        drawn.where("h0 is not null").groupBy(*key)
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("lowest"), F.first("embedding").alias("embedding"), F.first("buckets").alias("buckets"))
        .withColumn("vertex", F.monotonically_increasing_id())
    )
    points = vertices.select("vertex", "copies", "embedding")

    def work(rows: DataFrame, key: str) -> DataFrame:
        return gathered(block_pairs(sized(rows, key), key, "vertex", block).join(points, "vertex").select(key, "piece", "side", "vertex", "copies", "embedding"), key)

    found = linked(work(vertices.select("vertex", F.explode("buckets").alias("bucket")), "bucket"), least)
    groups = checkpointed(connected_components(found.where("vertex <> root").select(F.col("vertex").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("vertex"), "component"))
    links = linked(work(groups, "component"), least).groupBy("vertex").agg(F.sum("links").alias("links"))
    names = groups.join(vertices.select("vertex", "lowest"), "vertex").groupBy("component").agg(F.min("lowest").alias("first"))
    by_vertex = checkpointed(
        vertices.select(*key, "vertex", "copies", "lowest").join(links, "vertex", "left")
        .join(dealt_join(groups, names, "component", "vertex", counts_of(groups, "component")).select("vertex", "first"), "vertex", "left")
        .select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "lowest").alias("component_id"), F.col("copies").alias("n"))
    )
    some = dealt_join(drawn.where("h0 is not null").select("vec_id", *key), by_vertex.drop("n"), key, "vec_id", by_vertex.select(*key, "n")).select("vec_id", "n_links", "component_id")
    none = drawn.where("h0 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
