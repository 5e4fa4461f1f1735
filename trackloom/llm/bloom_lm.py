"""Language-model scoring with a log-frequency Bloom filter.

Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end of text; n-grams are single tokens and pairs, known by
64-bit hashes. Counts over all learning texts are summed by Spark after each task has added up its own. A count ``c`` is quantised to
level 1 + floor(log(c) / log(base)), and the n-gram is put into the filter once for each level up to its own: a reader probes level
after level until one is missing, so a count costs as many probes as its logarithm. An n-gram lives in one segment, so each segment is
built by one task from its own n-grams, and has ``ENTRY_BITS`` bits for each entry that it counts: the filter grows with the corpus, and
every count is in it. It is read in slices of ``SLICE`` bytes at most, as many whole segments as fit. With one slice, scoring is one
pass; with more, each pass adds the levels of its slice to those carried along with the texts, one byte for a token and one for a pair.
(``build`` can also make segments of ``SEGMENT_BITS`` bits whose quantiser's floor rises above ``CAPACITY`` entries; ``score`` doesn't.)

The probability of a token after another interpolates the pair's relative frequency with the token's own smoothed frequency; the weight
for each level of the first token's count is fitted by expectation maximisation, leaving one occurrence out, on all learning texts: it
depends on the levels of token, pair and first token only, and the table of how often each three occur together holds all there is to know. The base score is exact: frequent tokens' counts (the ``TOP`` most frequent, a fixed number) are broadcast, the others
are joined by hash.

Null and empty texts have the end token alone. With nothing to learn from, counts are 0. Rows are kept apart by position, so repeated
ids and rows are scored one by one; further columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, chunks, lowered, mix, signed, slice_hashes, string_column, words

SEGMENTS, SEGMENT_BITS, PROBES = 1024, 1 << 18, 4
CAPACITY = SEGMENT_BITS // 8
FLOORS = 12
ENTRY_BITS = 8
#: Bytes of the filter that are broadcast at once, and of them those that the driver collects at once.
SLICE, COLLECTED = 128 << 20, 16 << 20
TOP = 1 << 18
END = np.uint64(0x5DEECE66D1234567)
#: Quantiser bases of single tokens and pairs.
BASES = (2**0.5, 2.0)


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, row of each, offsets of the rows' tokens), an end token after each row's words."""
    raw = lowered(raw)
    s, e, row = words(raw, at)
    n = len(at) - 1
    count = np.bincount(row, minlength=n) + 1
    upto = np.concatenate(([0], np.cumsum(count)))
    out = np.full(int(upto[-1]), END, np.uint64)
    out[np.arange(len(s)) + row] = slice_hashes(raw, s, e)
    return out, np.repeat(np.arange(n), count), upto


def pairs(token: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token before each token, the pair's hash); the first of a row follows the end token."""
    before = np.concatenate(([END], token[:-1]))
    before[upto[:-1]] = END
    with np.errstate(over="ignore"):
        return before, mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def counted(docs: DataFrame, order: int, hold: int = 8 << 20) -> DataFrame:
    """gram, n: added up by each task over every ``hold`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(gram)), pa.array(n.astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for _, _, raw, at in chunks(string_column(batch, "text")):
                token, _, upto = tokens(raw, at)
                kept.append(token if order == 1 else pairs(token, upto)[1])
                size += len(raw)
                if size > hold:
                    yield flush()
                    size = 0
        if kept:
            yield flush()

    return docs.select("text").mapInArrow(run, "gram long, n long")


def places(gram: np.ndarray, level: np.ndarray | int, kind: np.ndarray | int, bits: np.ndarray | int = SEGMENT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(segment, PROBES bit positions in it) of n-grams at a level; ``bits``: how many the segment has."""
    with np.errstate(over="ignore"):
        a = mix(gram + np.asarray(kind, np.uint64) * np.uint64(0xA24BAED4963EE407) + np.asarray(level, np.uint64) * np.uint64(0x9FB21C651E98DF25))
        b = mix(a) | np.uint64(1)
        steps = np.arange(PROBES, dtype=np.uint64)[:, None]
        return segment(gram), ((a + steps * b) >> np.uint64(20)) % np.asarray(bits, np.uint64)


def segment(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(54)).astype(np.int64)


def levels(n: np.ndarray, kind: int) -> np.ndarray:
    return 1 + np.floor(np.log(n) / np.log(BASES[kind]) + 1e-9).astype(np.int64)


def build(batches: Iterator[pa.RecordBatch], sized: bool = False) -> Iterator[pa.RecordBatch]:
    """Segments, as sorted rows (segment, kind, gram, n) come in; ``sized``: each as large as its entries need, and none left out."""
    here, kept = -1, []

    def done() -> pa.RecordBatch:
        gram, kind, top = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        held = [int(np.maximum(top - f, 0).sum()) for f in range(1 if sized else FLOORS)]
        floor = 0 if sized else next((f for f, n in enumerate(held) if n <= CAPACITY), FLOORS - 1)
        bits = np.zeros(-(-ENTRY_BITS * held[0] // 512) * 512 if sized else SEGMENT_BITS, bool)
        for k in range(0, len(gram), 1 << 14):
            g, t = gram[k : k + (1 << 14)], np.maximum(top[k : k + (1 << 14)] - floor, 0)
            level = np.arange(1, int(t.sum()) + 1) - np.repeat(np.cumsum(t) - t, t) + floor
            bits[places(np.repeat(g, t), level, np.repeat(kind[k : k + (1 << 14)], t), len(bits))[1].ravel()] = True
        return pa.RecordBatch.from_arrays([pa.array([here]), pa.array([floor + 1]), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["segment", "floor", "bits"])

    for batch in batches:
        seg, kind, gram, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        top = np.where(kind == 0, levels(n, 0), levels(n, 1))
        for s in np.unique(seg).tolist():
            if s != here:
                if here >= 0:
                    yield done()
                here = s
            at = seg == s
            kept.append((gram[at].view(np.uint64), kind[at], top[at]))
    if here >= 0:
        yield done()


def slices(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """(first, last) of runs of segments, each of ``most`` bytes or a single segment; sizes: (segment, bytes) in order."""
    out: list[list[int]] = []
    for s, n in sizes:
        if out and out[-1][2] + n <= most:
            out[-1][1:] = s, out[-1][2] + n
        else:
            out.append([s, s, n])
    return [(a, b) for a, b, _ in out]


class Filter:
    """The segments of ``rows`` (segment, floor, bits); an n-gram of another segment has level 0."""

    def __init__(self, rows: Iterable[tuple[int, int, bytes]], total: int, vocabulary: int) -> None:
        self.start, self.width, self.floor = np.zeros(SEGMENTS, np.int64), np.zeros(SEGMENTS, np.int64), np.ones(SEGMENTS, np.int64)
        bits = bytearray()
        for s, floor, b in rows:
            self.start[s], self.width[s], self.floor[s] = len(bits), 8 * len(b), floor
            bits += b
        self.bits = np.frombuffer(bits, np.uint8)
        self.total, self.vocabulary = total, vocabulary
        self.weight = np.full(64, 0.5)

    def level(self, gram: np.ndarray, kind: int) -> np.ndarray:
        """The level of each n-gram, 0 if the filter hasn't it: level after level is probed until one is missing."""
        seg = segment(gram)
        out, active = np.zeros(len(gram), np.int64), np.flatnonzero(self.width[seg])
        at = self.floor[seg[active]] - 1
        while len(active):
            at = at + 1
            seg, bit = places(gram[active], at, kind, self.width[segment(gram[active])])
            byte = self.bits[self.start[seg] + (bit >> np.uint64(3)).astype(np.int64)]
            there = ((byte >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1).all(0) & (at < 64)
            active, at = active[there], at[there]
            out[active] = at
        return out

    def found(self, token: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The level of each token, and of the pair that it ends."""
        kinds, back = np.unique(token, return_inverse=True)
        return self.level(kinds, 0)[back].astype(np.uint8), self.level(pairs(token, upto)[1], 1).astype(np.uint8)

    def count(self, level: np.ndarray, kind: int) -> np.ndarray:
        """What a level stands for: the middle of the counts that it holds."""
        base = BASES[kind]
        low = np.ceil(base ** (level - 1.0) - 1e-9)
        return np.where(level > 0, (low + np.maximum(low, np.ceil(base**level - 1e-9) - 1)) / 2, 0.0)

    def alone(self, level: np.ndarray) -> np.ndarray:
        return (self.count(level, 0) + 0.1) / (self.total + 0.1 * (self.vocabulary + 1))

    def logs(self, upto: np.ndarray, level: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 P of each token after the one before it, from the levels of tokens and pairs."""
        first = before(upto, level)
        joint, from_ = self.count(pair, 1), self.count(first, 0)
        relative = joint / np.maximum(np.maximum(from_, joint), 1)
        w = np.where(from_ > 0, self.weight[first], 0)
        return np.log10(w * relative + (1 - w) * self.alone(level))

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int = 12) -> None:
        """Weights from texts: (upto, level, pair)."""
        if texts:
            self.fit_counts(*(np.concatenate(x) for x in zip(*((before(upto, level), level, pair) for upto, level, pair in texts), strict=True)), 1, rounds)

    def fit_counts(self, first: np.ndarray, level: np.ndarray, pair: np.ndarray, n: np.ndarray | int, rounds: int = 12) -> None:
        """Weights of the pair's relative frequency, by level of the first token, leaving the occurrence at hand out; n: how often the three levels occur."""
        if not len(first):
            return
        joint, from_ = self.count(pair, 1), self.count(first, 0)
        r = np.minimum(1, np.maximum(joint - 1, 0) / np.maximum(from_ - 1, 1))
        a = (np.maximum(self.count(level, 0) - 1, 0) + 0.1) / (self.total + 0.1 * (self.vocabulary + 1))
        n = np.broadcast_to(np.asarray(n, float), first.shape)
        seen = np.bincount(first, n, 64)
        for _ in range(rounds):
            w = self.weight[first]
            share = w * r / (w * r + (1 - w) * a)
            self.weight = np.clip((np.bincount(first, n * share, 64) + 1) / (seen + 2), 0.02, 0.95)


def before(upto: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The level of the token before each; before a row's first stands the end token, which is also its last."""
    first = np.concatenate(([0], level[:-1])).astype(np.int64)
    first[upto[:-1]] = level[upto[1:] - 1]
    return first


def carried(column: pa.Array, start: int, end: int) -> np.ndarray | int:
    """The bytes of rows start to end of a binary column one after another; 0 if they are null."""
    part = column.slice(start, end - start).cast(pa.large_binary())
    if part.null_count:
        return 0
    _, offsets, data = part.buffers()
    at = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def add_levels(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """rid, doc_id, held_out, text, word, pair, learn: the levels of the slice at hand are added to word and pair."""
    for batch in batches:
        for start, end, raw, at in chunks(string_column(batch, "text"), 1 << 20):
            token, _, upto = tokens(raw, at)
            summed = [(own + carried(batch.column(4 + i), start, end)).astype(np.uint8) for i, own in enumerate(shared.value.found(token, upto))]
            found = [pa.Array.from_buffers(pa.binary(), end - start, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(x)]) for x in summed]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, end - start) for i in range(4)), *found, batch.column(6).slice(start, end - start)], names=batch.schema.names)


def level_rows(word: pa.Array, pair: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, upto, level, pair) of successive rows of about a million tokens."""
    upto = np.concatenate(([0], np.cumsum(pc.binary_length(word).to_numpy(zero_copy_only=False)))).astype(np.int64)
    start = 0
    while start < len(word):
        end = min(len(word), max(start + 1, int(np.searchsorted(upto, upto[start] + (1 << 20), "right")) - 1))
        yield start, end, upto[start : end + 1] - upto[start], carried(word, start, end), carried(pair, start, end)
        start = end


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """code, n: how often each three levels (of the token before, the token and the pair, six bits each) occur in rows word, pair."""
    total = np.zeros(1 << 18, np.int64)
    for batch in batches:
        for _, _, upto, level, pair in level_rows(batch.column(0), batch.column(1)):
            total += np.bincount((before(upto, level) << 12) + (level.astype(np.int64) << 6) + pair, minlength=len(total))
    code = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])


def score(docs: DataFrame, learn: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text; the rows where ``learn`` holds are learnt from."""
    spark = docs.sparkSession
    training = docs.where(learn)
    single = checkpointed(counted(training, 1).groupBy("gram").agg(F.sum("n").alias("n")))
    size = single.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds")).first()
    top = single.orderBy(F.desc("n"), "gram").limit(TOP).toArrow()
    grams = (
        counted(training, 2).withColumn("kind", F.lit(1)).unionByName(single.withColumn("kind", F.lit(0)))
        .select(F.shiftrightunsigned("gram", 54).cast("long").alias("segment"), "kind", "gram", "n")
    )
    parts = min(SEGMENTS, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))  # a task sorts all pairs of its segments
    built = checkpointed(
        grams.repartition(parts, "segment").groupBy("segment", "kind", "gram").agg(F.sum("n").alias("n"))
        .sortWithinPartitions("segment").mapInArrow(partial(build, sized=True), "segment long, floor long, bits binary")
    )
    sizes = [tuple(r) for r in built.select("segment", F.length("bits")).orderBy("segment").collect()]

    def rows_of(first: int, last: int) -> Iterator[tuple[int, int, bytes]]:
        for a, b in slices([x for x in sizes if first <= x[0] <= last], COLLECTED):
            yield from built.where(F.col("segment").between(a, b)).collect()

    none = F.lit(None).cast("binary")
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text", none.alias("word"), none.alias("pair"), F.coalesce(learn, F.lit(False)).alias("learn"))
    ranges = slices(sizes, SLICE) or [(0, -1)]
    for a, b in ranges:
        model = Filter(rows_of(a, b), size.total, size.kinds)
        if (a, b) != ranges[-1]:
            slice_ = spark.sparkContext.broadcast(model)
            keyed = checkpointed(keyed.mapInArrow(partial(add_levels, shared=slice_), keyed.schema))
            slice_.destroy()
    shared = spark.sparkContext.broadcast((model, *(top.column(i).to_numpy() for i in (0, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, gram, count = shared.value
        order = np.argsort(gram)
        gram, count = gram[order], count[order]
        scale = model.total + 0.1 * (model.vocabulary + 1)
        for batch in batches:
            rid, ids, held = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            for start, end, raw, at in chunks(string_column(batch, "text"), 1 << 20):
                token, row, upto = tokens(raw, at)
                n = end - start
                levels_ = [(own + carried(batch.column(4 + i), start, end)).astype(np.uint8) for i, own in enumerate(model.found(token, upto))]
                keys, back = np.unique(signed(token), return_inverse=True)
                i = np.minimum(np.searchsorted(gram, keys), max(0, len(gram) - 1))
                hit = gram[i] == keys if len(gram) else np.zeros(len(keys), bool)
                c = np.where(hit, count[i] if len(gram) else 0, 0)
                hit, base = hit[back], np.where(hit, np.log10((c + 0.1) / scale), 0)[back]
                rest = np.flatnonzero(~hit)
                both, tf = np.unique(np.rec.fromarrays([row[rest], signed(token)[rest]], names="row,gram"), return_counts=True) if len(rest) else (None, np.zeros(0, np.int64))
                lists = pa.array((np.searchsorted(both["row"], np.arange(n + 1)) if len(rest) else np.zeros(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[start:end]), ids.slice(start, n), held.slice(start, n), batch.column(6).slice(start, n), pa.array(np.diff(upto)), pa.array(np.bincount(row, hit, n).astype(np.int64)), pa.array(np.bincount(row, base, n))]
                    + [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(x)]) for x in levels_]
                    + [pa.ListArray.from_arrays(lists, pa.array(np.ascontiguousarray(both["gram"]) if len(rest) else np.zeros(0, np.int64))), pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int64)))],
                    names=["rid", "doc_id", "held_out", "learn", "n_tokens", "known", "base", "word", "pair", "grams", "tfs"],
                )

    # The texts are read once; what the weights and the scores need is kept: two bytes a token, and the counts of rarer tokens.
    kept = checkpointed(keyed.mapInArrow(run, "rid long, doc_id long, held_out boolean, learn boolean, n_tokens long, known long, base double, word binary, pair binary, grams array<long>, tfs array<long>"))
    tally = kept.where("learn").select("word", "pair").mapInArrow(tallied, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, often = (tally.column(i).to_numpy() for i in (0, 1))
    weights = copy.copy(model)
    weights.bits = np.zeros(0, np.uint8)  # levels are known by now
    weights.fit_counts(code >> 12, code >> 6 & 63, code & 63, often)

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, upto, level, pair in level_rows(batch.column(6), batch.column(7)):
                total = np.bincount(np.repeat(np.arange(end - start), np.diff(upto)), weights.logs(upto, level.astype(np.int64), pair.astype(np.int64)), end - start)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, end - start) for i in range(6)), pa.array(total)], names=[*batch.schema.names[:6], "logs"])

    own = ["doc_id", "held_out", "n_tokens", "known", "base"]
    scored = kept.select("rid", *own, "word", "pair").mapInArrow(logs, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, logs double")
    rarer = kept.select("rid", F.explode(F.arrays_zip("grams", "tfs")).alias("g")).select("rid", F.col("g.grams").alias("gram"), F.col("g.tfs").alias("tf"))
    found = scored.withColumns({"gram": F.xxhash64("rid"), "tf": F.lit(0).cast("long")}).unionByName(rarer, True)
    scale = float(size.total) + 0.1 * (size.kinds + 1)
    count = F.coalesce(F.col("n"), F.lit(0))
    summed = (
        found.join(single, "gram", "left").groupBy("rid").agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
            (F.max("known") + F.sum(F.when(count > 0, F.col("tf")).otherwise(0))).alias("n_known"),
            (F.max("base") + F.sum(F.when(F.col("tf") > 0, F.col("tf") * F.log10((count + 0.1) / scale)).otherwise(0.0))).alias("base_score"),
            F.max("logs").alias("score"),
        )
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(size.total).cast("long").alias("train_tokens"), "base_score", "score")
