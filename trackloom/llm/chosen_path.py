"""N-gram Jaccard join by chosen paths (Christiani, Pagh and Sivertsen, 2018).

A text is the set of its distinct shingles of ``size`` words; texts with equal sets are one vertex with a number of copies. Sets are
embedded as ``SIGNATURE`` minhash tokens (position, value), whose share that two sets hold in common estimates their Jaccard similarity.
Each run walks a tree: at a node, one or two positions (1 / threshold on average) are sampled from the node's own random seed, and the
node's sets are split by their token there, so that sets stay together on tokens they share. Nodes of at most ``leaf`` sets are compared
by brute force; larger ones are split again up to ``depth`` times, and what is still larger then is compared whole, in blocks. Runs are
repeated until two sets at the threshold are missed with probability below 1 - ``recall``.

Comparison in a node is by signature, with a margin of ``margin`` below the threshold (4.4 standard deviations at 64 tokens), and gives
candidate components only. Each candidate component is then compared exactly, set against set, in blocks: this yields every vertex's
links and the true links' components, the classes. Rows written grow with the texts and with blocks, not with pairs.

Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than ``size`` words is one shingle of all of them. Null and
empty texts, and those of white space alone, have no links and are classes of their own. Copies count as links. Rows without an id link
like others, but name no class: a class without any id has a null class_id. Rows repeated with the same id count as copies; an empty
table gives no rows; further columns are ignored.

Sets are told apart by a 128-bit hash, and numbered by the table of distinct ones. A pair at the threshold is lost if no run puts it into
one leaf (below 1 - ``recall``) or its signatures agree in less than threshold - margin (below 2e-5 at 64 tokens and the defaults).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, chunks, lowered, mix, signed, slice_hashes, string_column, words
from .blocks import block_pairs, counts_of, dealt_join, forest, gathered, pairs_of, sized, whole_groups
from .components import connected_components

SIGNATURE = 64
_SEEDS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, offsets of the rows'), sorted within rows."""
    raw = lowered(raw)
    s, e, row = words(raw, at)
    h, n = slice_hashes(raw, s, e), len(at) - 1
    count = np.bincount(row, minlength=n)
    full = np.minimum(count, size)
    made = np.where(count > 0, count - full + 1, 0)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    owner = np.repeat(np.arange(n), made)
    start = np.repeat(first - np.concatenate(([0], np.cumsum(made)))[:-1], made) + np.arange(made.sum())
    key = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            use = full[owner] > k
            key[use] = mix(key[use] * np.uint64(0x9E3779B97F4A7C15) + h[start[use] + k])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.searchsorted(owner, np.arange(n + 1))


def digests(key: np.ndarray, upto: np.ndarray) -> list[np.ndarray]:
    """A 128-bit name of each set, as two arrays of 64 bits."""
    full = np.flatnonzero(np.diff(upto))
    out = [np.zeros(len(upto) - 1, np.uint64) for _ in range(2)]
    if len(full):
        size = np.diff(upto)[full].astype(np.uint64)
        with np.errstate(over="ignore"):
            for half, seed in zip(out, (0x9FB21C651E98DF25, 0xA24BAED4963EE407), strict=True):
                half[full] = mix(np.add.reduceat(mix(key + np.uint64(seed)), upto[full]) + size)
    return out


def signatures(key: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """(sets, SIGNATURE) minhash tokens of non-empty sets; empty sets get zeros."""
    full = np.flatnonzero(np.diff(upto))
    out = np.zeros((len(upto) - 1, SIGNATURE), np.int32)
    if len(full):
        at = upto[full]
        with np.errstate(over="ignore"):
            for i, seed in enumerate(_SEEDS):
                x = key * seed
                x ^= x >> np.uint64(32)
                x *= np.uint64(0x9FB21C651E98DF25)
                out[full, i] = (np.minimum.reduceat(x, at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: -1, with no_id), two hashes of the text, and the text: what tells rows apart that are not repeated rows."""
    ids = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(ids, F.lit(-1)).alias("row_id"), ids.isNull().alias("no_id"), F.xxhash64("text").alias("t0"), F.xxhash64(F.lit(1), "text").alias("t1"), "text")


ROW = ["row_id", "no_id", "t0", "t1"]


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """ROW, two halves of the set's name (null without shingles) and the signature of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, at in chunks(string_column(batch, "text"), 2 << 20):
                key, upto = shingles(raw, at, size)
                none = np.diff(upto) == 0
                flat = signatures(key, upto)
                packed = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, SIGNATURE, dtype=np.int32)), pa.array(flat.ravel()))
                names = [pa.array(signed(h), mask=none) for h in digests(key, upto)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(4)), *names, packed], names=[*ROW, "h0", "h1", "tokens"])

    return keyed(docs).mapInArrow(run, "row_id long, no_id boolean, t0 long, t1 long, h0 long, h1 long, tokens array<int>")


def walk(tokens: DataFrame, runs: int, depth: int, leaf: int, threshold: float) -> DataFrame:
    """(node, vertex, n): the nodes of all runs' trees that are compared."""

    def split(rows: DataFrame) -> DataFrame:
        seed = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 20))
        more = seed(1) < int((1 / threshold - 1) * (1 << 20))
        place = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(SIGNATURE)).cast("int")
        chosen = F.when(more & (place(2) != place(3)), F.array(place(2), place(3))).otherwise(F.array(place(2)))
        return rows.withColumn("place", F.explode(chosen)).select(F.xxhash64("node", "place", F.get("tokens", F.col("place"))).alias("node"), "vertex")

    roots = tokens.withColumn("node", F.explode(F.array(*(F.lit(r).cast("long") for r in range(runs)))))
    front = split(roots)
    done = []
    for level in range(depth):
        here = sized(front, "node")
        if level == depth - 1:
            done.append(here)
            break
        here = checkpointed(here)
        done.append(here.where(F.col("n") <= leaf))
        large = here.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        front = split(large.select("node", "vertex").join(tokens, "vertex"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def candidates(nodes: DataFrame, tokens: DataFrame, block: int, least: float) -> DataFrame:
    """(a, b): a spanning forest, in each piece of work, of the pairs whose signatures agree in a share of at least ``least``."""
    work = gathered(block_pairs(nodes, "node", "vertex", block).join(tokens, "vertex").select("node", "piece", "side", "vertex", "tokens"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches):
            side, vertex = rows.column(2).to_numpy(), rows.column(3).to_numpy()
            token = rows.column(4).combine_chunks().flatten().to_numpy().reshape(-1, SIGNATURE)
            a, b = [], []
            for i, j in pairs_of(at, side):
                for k in range(0, len(i), 50_000):
                    x, y = i[k : k + 50_000], j[k : k + 50_000]
                    near = (token[x] == token[y]).sum(1, dtype=np.uint8) >= least * SIGNATURE
                    a.append(x[near])
                    b.append(y[near])
            if a:
                root = forest(len(vertex), np.concatenate(a), np.concatenate(b))
                moved = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(vertex[moved]), pa.array(vertex[root[moved]])], names=["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def compared(work: DataFrame, threshold: float) -> DataFrame:
    """vertex, links (copies of vertices linked to it) and root (the end of a forest edge): one row per vertex in a piece of work.

    ``work`` has component, piece, side, vertex, copies, shingles.
    """

    def piece(sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(sets)
        size = np.array([len(s) for s in sets])
        if n == 2:
            common = np.array([[0, len(np.intersect1d(sets[0], sets[1], True))]] * 2)
            common[1] = common[0][::-1]
        else:
            kind, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(n), size)
            use = count[back] > 1
            column, owner = (np.cumsum(count > 1) - 1)[back[use]], owner[use]
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            common, width = np.zeros((n, n), np.float32), 8192
            for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
                a, b = np.searchsorted(column, (first, first + width))
                held = np.zeros((n, min(width, int(column[-1]) + 1 - first)), np.float32)
                held[owner[a:b], column[a:b] - first] = 1
                common += held @ held.T
        link = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
        np.fill_diagonal(link, False)
        if side[0] >= 0:
            link &= side[:, None] != side[None, :]
        return link @ copies, forest(n, *np.nonzero(link))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches):
            side, vertex, copies = (rows.column(i).to_numpy() for i in (2, 3, 4))
            held = rows.column(5).combine_chunks()
            flat, upto = held.values.to_numpy().view(np.uint64), held.offsets.to_numpy()
            links, root = np.zeros(len(vertex), np.int64), np.arange(len(vertex))
            for first, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                mine = first + np.unique(vertex[first:end], return_index=True)[1]
                if len(mine) > 1:
                    links[mine], r = piece([flat[upto[i] : upto[i + 1]] for i in mine.tolist()], side[mine], copies[mine])
                    root[mine] = mine[r]
            yield pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(links), pa.array(vertex[root])], names=["vertex", "links", "root"])

    return work.select("component", "piece", "side", "vertex", "copies", "shingles").mapInArrow(run, "vertex long, links long, root long")


def join(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.999, leaf: int = 250, depth: int = 3, block: int = 1000, margin: float = 0.22) -> DataFrame:
    """doc_id, class_id (smallest id of the class) and n_links (rows linked directly, copies included) of every row."""
    one = threshold * (1 - (1 / threshold - 1)) + (1 - (1 - threshold) ** 2) * (1 / threshold - 1)
    runs = math.ceil(math.log(1 - recall) / math.log(1 - one**depth))
    drawn = checkpointed(sketch(docs, size))
    some = drawn.where("h0 is not null")
    vertices = checkpointed(
        some.groupBy("h0", "h1")
        .agg(F.count("*").alias("copies"), F.min(F.when(~F.col("no_id"), F.col("row_id"))).alias("lowest"), F.min(F.struct("no_id", "row_id", "t0", "t1")).alias("row"), F.first("tokens").alias("tokens"))
        .select(F.monotonically_increasing_id().alias("vertex"), "h0", "h1", "copies", "lowest", *(F.col(f"row.{c}").alias(c) for c in ROW), "tokens")
    )
    tokens = vertices.select("vertex", "tokens")
    near = candidates(walk(tokens, runs, depth, leaf, threshold), tokens, block, threshold - margin)
    groups = connected_components(near)

    wanted = sized(groups.withColumnRenamed("id", "vertex"), "component").join(vertices.select("vertex", "copies", *ROW), "vertex")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, at in chunks(string_column(batch, "text"), 2 << 20):
                key, upto = shingles(raw, at, size)
                part = batch.slice(first, end - first)
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(signed(key)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), lists], names=["vertex", "component", "copies", "n", "shingles"])

    # A vertex is read from the one row that stands for it; repeated rows fall together before they are joined.
    once = keyed(docs).groupBy(*ROW).agg(F.first("text").alias("text"))
    texts = once.join(wanted.hint("shuffle_hash"), ROW).select("vertex", "component", "copies", "n", "text")
    sets = texts.mapInArrow(read, "vertex long, component long, copies long, n long, shingles array<long>")
    exact = checkpointed(compared(gathered(block_pairs(sets, "component", "vertex", block // 4), "component"), threshold))
    classes = connected_components(exact.select(F.col("vertex").alias("a"), F.col("root").alias("b")))
    named = classes.join(vertices.select(F.col("vertex").alias("id"), "lowest"), "id")
    names = named.groupBy("component").agg(F.min("lowest").alias("class_id"))
    by_vertex = checkpointed(
        vertices.select("vertex", "h0", "h1", "copies", "lowest")
        .join(exact.groupBy("vertex").agg(F.sum("links").alias("links")), "vertex", "left")
        .join(dealt_join(classes, names, "component", "id", counts_of(classes, "component")).select(F.col("id").alias("vertex"), F.struct("class_id").alias("class")), "vertex", "left")
        .select("h0", "h1", F.when(F.col("class").isNotNull(), F.col("class.class_id")).otherwise(F.col("lowest")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n"))
    )
    doc_id = F.when(~F.col("no_id"), F.col("row_id")).alias("doc_id")
    linked = dealt_join(some.select("row_id", "no_id", "h0", "h1"), by_vertex.drop("n"), ["h0", "h1"], "row_id", by_vertex.select("h0", "h1", "n")).select(doc_id, "class_id", "n_links")
    return linked.unionByName(drawn.where("h0 is null").select(doc_id, doc_id.alias("class_id"), F.lit(0).cast("long").alias("n_links")))
