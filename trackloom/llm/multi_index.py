"""Nearest neighbours by inner product with multi-index hashing (Norouzi, Punjani and Fleet, 2012).

Vectors get one more component that makes all lengths equal, so that the largest inner product is the smallest angle (queries get a 0
there). Codes of ``BITS`` bits come from several rotations, each learned from a bounded sample by iterative quantisation (Gong and
Lazebnik, 2011). Codes are cut into substrings of about log2(rows) bits, and each has a table of buckets. By the pigeonhole principle
every code within Hamming radius r of a query agrees with it in some substring up to r // substrings bits (for substrings beyond the
remainder, one bit less). So the substrings that differ from the query's in that many bits are enumerated and their buckets looked up;
whole codes are compared for the rows retrieved only, and those within the radius are reranked by the exact inner product in double
precision.

The radius is the query's own: a first probe, as wide as the sample's queries need for ``k`` neighbours, is widened until it gives ``k``;
the worst angle among them bounds what is still to be found, and the last probe goes as far as a code at that angle lies with a
probability of about 0.97, as measured on the sample. No bucket or list of candidates has a cap.

Rows are dealt into shards, each indexed by one task, past which the stated queries stream in batches, and the best ``k`` of each shard
are merged. Shards grow with the table up to ``MOST`` vectors, so that queries are copied to as few of them as memory allows. The sample (at most ``sample`` rows, those of least hash of their id) only shapes
the codes. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id; fewer
candidates than ``k`` are all returned; ties go to the smaller id; rows that share the query's id are the query's own. An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import whole_groups
from .bpe import gather
from .crosspoly import vectors

BITS, PIECE = 256, 16  # a substring has at most PIECE bits
#: Rows of a shard: a sixteenth of all, but neither fewer nor more than this.
LEAST, MOST = 4096, 1 << 16


@dataclass
class Coder:
    rotation: np.ndarray  # (d + 1, BITS)
    longest: float
    line: tuple[float, float]  # expected Hamming distance by angle
    spread: float  # of the distance, over that of independent bits
    usual: np.ndarray  # the sample's Hamming distances, in order

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, BITS) bits."""
        d = len(self.rotation) - 1
        if x.shape[1] < d:
            x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
        y = np.zeros((len(x), d + 1))
        y[:, :d] = x[:, :d]
        if not query:
            y[:, d] = np.sqrt(np.maximum(0, self.longest**2 - (y[:, :d] ** 2).sum(1)))
        return y @ self.rotation >= 0

    def first(self, share: float) -> int:
        """A radius that usually holds such a share of the rows."""
        at = np.searchsorted(np.geomspace(1e-5, 1, len(self.usual)), min(1.0, share))
        return int(self.usual[min(at, len(self.usual) - 1)])

    def radius(self, worst: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """How far a code with at least this inner product is to be looked for."""
        angle = np.arccos(np.clip(worst / np.maximum(norm * self.longest, 1e-300), -1, 1))
        middle = np.clip(self.line[0] + self.line[1] * angle, 0, BITS)
        share = np.clip(middle / BITS, 0.005, 0.995)
        return np.clip(np.ceil(middle + 1.9 * self.spread * np.sqrt(BITS * share * (1 - share))), 0, BITS).astype(int)


def fit(x: np.ndarray, longest: float, rounds: int = 15) -> Coder:
    """Rotations from a sample, and how Hamming distance follows the angle on its pairs."""
    d = x.shape[1]
    y = np.concatenate((x, np.sqrt(np.maximum(0, longest**2 - (x**2).sum(1)))[:, None]), 1)
    rng, columns = np.random.default_rng(5), []
    for _ in range(math.ceil(BITS / (d + 1))):
        r = np.linalg.qr(rng.normal(size=(d + 1, d + 1)))[0]
        for _ in range(rounds):
            z = y @ r
            u, _, v = np.linalg.svd(y.T @ np.where(z >= 0, 1.0, -1.0))
            r = u @ v
        columns.append(r)
    coder = Coder(np.concatenate(columns, 1)[:, :BITS], longest, (0.0, BITS / np.pi), 1.0, np.zeros(1))
    ask = x[: min(400, len(x))]
    a, b = coder.codes(ask, True), coder.codes(x, False)
    far = (a[:, None, :].astype(np.float32) != b[None, : min(800, len(b)), :]).sum(2).ravel()
    coder.usual = np.quantile(far, np.geomspace(1e-5, 1, 200))
    x, norm = x[: min(800, len(x))], np.linalg.norm(ask, axis=1)
    angle = np.arccos(np.clip(ask @ x.T / (norm[:, None] * longest), -1, 1)).ravel()
    use = angle < np.quantile(angle, 0.5)
    if use.sum() > 50 and np.ptp(angle[use]) > 0.2:
        slope = (angle[use] @ far[use]) / (angle[use] @ angle[use])  # a line through the origin: equal vectors have equal codes
        rest = far[use] - slope * angle[use]
        share = np.clip(slope * angle[use] / BITS, 0.005, 0.995)
        coder.line, coder.spread = (0.0, float(slope)), float(max(0.7, np.sqrt(np.mean(rest**2 / (BITS * share * (1 - share))))))
    return coder


class Shard:
    """Rows by the buckets of their codes' substrings. A substring has about as many bits as would number the rows."""

    def __init__(self, coder: Coder, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.coder, self.ids, self.x = coder, ids[order], x[order]
        bits = coder.codes(self.x, False)
        self.words = np.packbits(bits, 1).view(np.uint64)
        self.piece = min(PIECE, max(4, round(math.log2(len(ids)))))
        self.tables = []
        for value in self.cut(bits):
            upto = np.concatenate(([0], np.cumsum(np.bincount(value, minlength=1 << self.piece))))
            self.tables.append((upto, np.argsort(value, kind="stable")))
        near = np.bitwise_count(np.arange(1 << self.piece, dtype=np.uint32))
        self.masks = np.argsort(near, kind="stable")  # differences of a substring, those of fewest bits first
        self.upto = np.cumsum(np.bincount(near, minlength=self.piece + 1))
        self.retrieved = 0

    def cut(self, bits: np.ndarray) -> list[np.ndarray]:
        """The substrings, as numbers."""
        return [bits[:, i : i + self.piece] @ (1 << np.arange(min(self.piece, BITS - i))) for i in range(0, BITS, self.piece)]

    def probed(self, bits: np.ndarray, radius: np.ndarray, done: np.ndarray | None = None) -> np.ndarray:
        """(queries, rows): which rows lie in a bucket that a query's radius makes it look up; buckets of a radius ``done`` are left out."""
        pieces = len(self.tables)
        found = np.zeros((len(bits), len(self.ids)), bool)
        reach_of = lambda r, j: np.clip(r // pieces - (j > r % pieces), -1, self.piece)
        before = np.concatenate(([0], self.upto))  # masks of fewer bits than each reach
        for j, (mine, (upto, rows)) in enumerate(zip(self.cut(bits), self.tables, strict=True)):
            first = np.zeros(len(bits), int) if done is None else before[reach_of(done, j) + 1]
            last = before[reach_of(radius, j) + 1]
            for a, b in {(int(a), int(b)) for a, b in zip(first, last, strict=True) if a < b}:
                q = np.flatnonzero((first == a) & (last == b))
                bucket = mine[q, None] ^ self.masks[None, a:b]
                start = upto[bucket]
                count = upto[bucket + 1] - start
                some = gather(rows, start.ravel(), count.ravel())[0]
                found[np.repeat(q, count.sum(1)), some] = True
        return found

    def retrieve(self, bits: np.ndarray, radius: np.ndarray, far: np.ndarray, done: np.ndarray | None = None) -> None:
        """Whole codes are compared for rows that probing retrieves, unless they were before; ``far`` (queries, rows) takes the distances."""
        q, r = np.nonzero(self.probed(bits, radius, done) & (far > BITS))
        self.retrieved += len(q)
        code = np.packbits(bits, 1).view(np.uint64)
        for k in range(0, len(q), 200_000):
            a, b = q[k : k + 200_000], r[k : k + 200_000]
            far[a, b] = np.bitwise_count(code[a] ^ self.words[b]).sum(1, dtype=np.int16)

    def within(self, bits: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the codes within each query's radius."""
        far = np.full((len(bits), len(self.ids)), BITS + 1, np.int16)
        self.retrieve(bits, radius, far)
        return np.nonzero(far <= radius[:, None])

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, inner product) of the best ``k`` found for each query."""
        if queries.shape[1] < self.x.shape[1]:
            queries = np.pad(queries, ((0, 0), (0, self.x.shape[1] - queries.shape[1])))
        y = queries[:, : self.x.shape[1]]
        norm, bits = np.linalg.norm(queries, axis=1), self.coder.codes(queries, True)
        radius = np.full(len(y), max(self.coder.first(2.5 * k / len(self.ids)), len(self.tables)))
        far = np.full((len(y), len(self.ids)), BITS + 1, np.int16)
        self.retrieve(bits, radius, far)
        q, r, s = self.rerank(*np.nonzero(far <= radius[:, None]), y, own, k)
        while True:
            worst, held = np.full(len(y), np.inf), np.bincount(q, minlength=len(y))
            np.minimum.at(worst, q, s)
            wider = np.where(held >= k, self.coder.radius(worst, norm), np.minimum(BITS, radius + len(self.tables)))
            again = np.flatnonzero((wider > radius) & (radius < BITS))
            if not len(again):
                return q, r, s
            done = ~np.isin(q, again)
            more = far[again]
            self.retrieve(bits[again], wider[again], more, radius[again])
            far[again] = more
            q2, r2, s2 = self.rerank(*np.nonzero(more <= wider[again][:, None]), y[again], own[again], k)
            q, r, s = (np.concatenate((a[done], b)) for a, b in ((q, again[q2]), (r, r2), (s, s2)))
            radius = np.maximum(radius, wider)

    def rerank(self, q: np.ndarray, r: np.ndarray, y: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = self.ids[r] != own[q]
        q, r = q[keep], r[keep]
        s = np.empty(len(q))
        for i in range(0, len(q), 50_000):
            s[i : i + 50_000] = np.einsum("ij,ij->i", y[q[i : i + 50_000]], self.x[r[i : i + 50_000]])
        order = np.lexsort((r, -s, q))  # rows are in the order of their ids
        q, r, s = q[order], r[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < k], r[place < k], s[place < k]


def nearest(table: DataFrame, is_query: Column, k: int = 20, sample: int = 4000, shard: int | None = None, batch: int = 128) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows of every query."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    fine = (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists("embedding", lambda v: v != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    about = rows.agg(F.count("*").alias("n"), F.max(squares).alias("longest"), F.max(F.size("embedding")).alias("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not about.n:
        return table.sparkSession.createDataFrame([], schema)
    order = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30))
    drawn = rows.where(order < int(min(1.0, 0.9 * sample / about.n) * (1 << 30)) + 1).orderBy(order, "vec_id").limit(sample).select("embedding").toArrow()
    x = vectors(drawn.column(0).combine_chunks())[0]
    x = np.pad(x, ((0, 0), (0, about.d - x.shape[1]))) if len(x) else np.ones((1, about.d))
    coder = table.sparkSession.sparkContext.broadcast(fit(x, math.sqrt(about.longest)))
    shards = math.ceil(about.n / (shard or min(MOST, max(LEAST, about.n // 16))))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(shards)).alias("shard"), F.lit(0).alias("query"), "vec_id", "embedding")
    asked = rows.where(is_query).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("query"), "vec_id", "embedding")
    work = dealt.unionAll(asked).repartition(max(12, shards), "shard").sortWithinPartitions("shard", "query", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, kept, index = None, [], [], None
        for rows, at in whole_groups(split(batches), 3):
            for first, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                part = rows.slice(first, end - first)
                number, query = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                if number != here:
                    here, ids, kept, index = number, [], [], None
                own = part.column(3).to_numpy()
                x = vectors(part.column(4).combine_chunks())[0]
                if not query:
                    ids.append(own)
                    kept.append(x)
                    continue
                if index is None:
                    if not kept:
                        continue
                    width = max(v.shape[1] for v in kept)
                    index = Shard(coder.value, np.concatenate(ids), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in kept]))
                q, r, s = index.search(own, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(index.ids[r]), pa.array(s)], names=["query_id", "vec_id", "score"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a third key that numbers runs of ``batch`` rows, so that neither index rows nor queries come as one group."""
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                split.count += 1
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(part.num_rows, split.count)), part.column(2), part.column(3)], names=["shard", "query", "run", "vec_id", "embedding"])

    split.count = 0
    found = work.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
