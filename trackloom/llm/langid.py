"""Language identification by a string kernel.

The kernel of two texts is the number of blended-spectrum n-grams (code-point n-grams of one to ``max_n``, lower-cased where ASCII or
Latin-1) that both hold, over the geometric mean of the numbers each holds; presence counts, not frequency. N-grams are known by 64-bit
hashes, each its own dimension. Nystroem landmarks map a text to its kernel values with them, whitened by the landmarks' own kernel
matrix, and one-versus-rest kernel ridge regression is solved in that space. As every step from a text's presence vector to its class
outputs is linear, landmarks and regression fold into one matrix of (n-gram of a landmark, class), and texts are scored by products of
presence vectors with it: the same function, without a pass over landmarks for each text.

Fitting reads a bounded sample: at most ``per_language`` texts of each language, those of least hash of their id and text, and of those
at most ``sample_bytes`` bytes of text in all, whole texts only. Everything else covers whole texts of all rows. A text that is null or
has no letter is ``und`` with score 0; with nothing to learn from, every text is. ``known`` is the share of a text's distinct n-grams
that some landmark holds. Ties between languages go to the first in alphabetical order. Repeated rows and an empty table need no care;
further columns stay, except those of the names of the columns added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import chunks, mix, quoted, string_column
from .bpe import LETTER, code_point_classes, gather

SLOTS = 1 << 22
#: Bytes of text that are labelled together: a pass holds some eighty bytes for each.
PART = 1 << 19
ADDED = ("lang_pred", "score", "known")


class Distinct:
    """Distinct 64-bit keys in linear time, by a table of ``SLOTS`` places; keys that meet another in their place are sorted instead."""

    def __init__(self) -> None:
        self.place = np.zeros(SLOTS, np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(42)).astype(np.int32)
        number = np.arange(len(keys), dtype=np.int32)
        self.place[slot] = number
        last = self.place[slot]
        met = keys[last] != keys
        return np.concatenate((keys[last == number], np.unique(keys[met]))) if met.any() else keys[last == number]


class Index:
    """The number of each of some distinct keys, from 1; 0 stands for any other key."""

    def __init__(self, keys: np.ndarray) -> None:
        self.given, self.keys = keys, np.concatenate((np.zeros(1, np.uint64), keys))
        self.shift = np.uint64(64 - min(22, max(8, (4 * len(keys)).bit_length())))
        slot, number = (keys >> self.shift).astype(np.int32), np.arange(1, len(self.keys), dtype=np.int32)
        self.place = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.place[slot] = number
        lost = number[self.place[slot] != number]
        lost = lost[np.argsort(self.keys[lost])]
        self.more, self.numbers = self.keys[lost], lost

    def __reduce__(self) -> tuple:
        return Index, (self.given,)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = self.place[(keys >> self.shift).astype(np.int32)]
        other = np.flatnonzero((found > 0) & (self.keys[found] != keys))
        if len(other):
            found[other] = 0
            if len(self.more):
                i = np.minimum(np.searchsorted(self.more, keys[other]), len(self.more) - 1)
                found[other] = np.where(self.more[i] == keys[other], self.numbers[i], 0)
        return found


@dataclass
class Model:
    languages: list[str]
    index: Index
    weights: np.ndarray  # (n-grams of landmarks + 1, languages); the first row, of all others, is 0
    bias: np.ndarray
    max_n: int
    sharpness: float


def grams(points: np.ndarray, edge: np.ndarray, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. max_n: (positions, keys) of the n-grams that lie within one text; ``edge`` marks the texts' first code points."""
    x = mix(points.astype(np.uint64) + np.uint64(1))
    key, whole = x, np.ones(len(points), bool)
    for n in range(1, max_n + 1):
        if n > 1:
            with np.errstate(over="ignore"):
                key = mix(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :])
            whole = whole[:-1] & ~edge[n - 1 : len(points)]
        where = np.flatnonzero(whole)
        yield where, key[where]


def points_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, lower-cased where a table of simple letters has it, and the offsets of the texts among them."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    return points + upper * np.uint32(32), np.searchsorted(lead, at)


def presence(raw: np.ndarray, at: np.ndarray, max_n: int, distinct: Distinct) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct n-grams) of every text that has a letter."""
    points, begin = points_of(raw, at)
    edge = np.zeros(len(points) + 1, bool)
    edge[begin] = True
    letters = np.concatenate(([0], np.cumsum(code_point_classes()[points] == LETTER)))
    keep = letters[begin[1:]] > letters[begin[:-1]]
    by_n = [(np.searchsorted(where, begin), key) for where, key in grams(points, edge, max_n)]
    for row in np.flatnonzero(keep).tolist():
        yield row, distinct(np.concatenate([key[upto[row] : upto[row + 1]] for upto, key in by_n]))


def fit(rows: list[tuple[str, str]], max_n: int = 4, landmarks: int = 256, ridge: float = 1e-3) -> Model | None:
    """A model from (text, language) pairs, in the given order; None if there is nothing to learn."""
    languages = sorted({lang for _, lang in rows})
    texts = pa.array([t for t, _ in rows], pa.large_string())
    distinct = Distinct()
    held = [(first + row, found) for first, _, raw, at in chunks(texts) for row, found in presence(raw, at, max_n, distinct)]
    if not held:
        return None
    n = len(held)
    size = np.sqrt(np.array([len(f) for _, f in held], np.float64))
    chosen = np.unique(np.linspace(0, n - 1, min(landmarks, n)).astype(int))
    # the landmarks' presence, n-gram by n-gram: which landmarks hold it
    owner = np.repeat(np.arange(len(chosen)), [len(held[i][1]) for i in chosen])
    keys, number = np.unique(np.concatenate([held[i][1] for i in chosen]), return_inverse=True)
    index = Index(keys)
    order = np.argsort(number, kind="stable")
    owner, upto = owner[order], np.concatenate(([0, 0], np.cumsum(np.bincount(number))))
    share = 1 / size[chosen]
    kernel = np.empty((n, len(chosen)))
    for i, (_, found) in enumerate(held):
        common = index(found)
        at = gather(owner, upto[common], upto[common + 1] - upto[common])[0]
        kernel[i] = np.bincount(at, minlength=len(chosen)) * share / size[i]
    among = kernel[chosen]
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ whiten
    target = np.array([[1.0 if rows[i][1] == lang else -1.0 for lang in languages] for i, _ in held])
    weight = 1 / np.maximum(1, (target > 0).sum(0))[np.argmax(target, 1)]
    weight /= weight.sum()
    mean, middle = weight @ features, weight @ target
    centred = features - mean
    beta = np.linalg.solve((centred * weight[:, None]).T @ centred + ridge * np.eye(centred.shape[1]), (centred * weight[:, None]).T @ (target - middle))
    each = (whiten @ beta) * share[:, None]
    weights = np.zeros((len(keys) + 1, len(languages)))
    for c in range(len(languages)):
        weights[1:, c] = np.bincount(np.repeat(np.arange(len(keys)), np.diff(upto[1:])), each[owner, c], len(keys))
    return Model(languages, index, weights.astype(np.float32), middle - mean @ beta, max_n, 4.0)


def outputs(model: Model, raw: np.ndarray, at: np.ndarray, distinct: Distinct) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(rows that have a letter, their class outputs, share of their n-grams that a landmark holds)."""
    rows, out, known = [], [], []
    for row, found in presence(raw, at, model.max_n, distinct):
        number = model.index(found)
        rows.append(row)
        out.append(model.weights[number].sum(0, dtype=np.float64) / np.sqrt(len(found)) + model.bias)
        known.append(np.count_nonzero(number) / len(found))
    return rows, np.array(out).reshape(len(rows), len(model.languages)), np.array(known)


def predict(model: Model, raw: np.ndarray, at: np.ndarray, distinct: Distinct) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number or -1, score, known) of each text."""
    n = len(at) - 1
    best, score, share = np.full(n, -1), np.zeros(n), np.zeros(n)
    rows, out, known = outputs(model, raw, at, distinct)
    if rows:
        z = out * model.sharpness
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best[rows], score[rows], share[rows] = p.argmax(1), p.max(1), known
    return best, score, share


def sample(docs: DataFrame, learn: Column, per_language: int, sample_bytes: int) -> list[tuple[str, str]]:
    """At most ``per_language`` (text, language) pairs of each language among the rows to learn from, by the hash of their id and text.

    The rows of each language are first counted; then those whose hash lies in a share that holds about as many are read, in the order of
    the hash, up to the bounds.
    """
    from_rows = docs.where(learn & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in from_rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, 0.9 * per_language / n) * (1 << 30))))])
    order = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long"), "text", F.lit(9)), F.lit(1 << 30))
    rank = Window.partitionBy("lang").orderBy("o", "t")
    chosen = from_rows.where(order < share[F.col("lang")]).select("lang", "text", order.alias("o"), F.xxhash64("text").alias("t"))
    first = chosen.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= per_language)
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(rank.rowsBetween(Window.unboundedPreceding, 0))
    rows = first.withColumn("upto", size).where(F.col("upto") <= sample_bytes // len(counts)).select("lang", "text", "o", "t").collect()
    return [(r.text or "", r.lang) for r in sorted(rows, key=lambda r: (r.o, r.t, r.lang))]


def identified(batches: Iterator[pa.RecordBatch], model: Model | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches, in parts of about ``PART`` bytes of text, with the language, score and known of each row."""
    distinct = Distinct()
    languages = [*(model.languages if model else []), "und"]
    for batch in batches:
        for first, end, raw, at in chunks(string_column(batch, "text"), PART):
            n = end - first
            guess, score, known = predict(model, raw, at, distinct) if model else (np.full(n, -1), np.zeros(n), np.zeros(n))
            yield pa.RecordBatch.from_arrays([*batch.slice(first, n).columns, pa.array([languages[i] for i in guess.tolist()], pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], names=names)


def identify(docs: DataFrame, learn: Column, per_language: int = 400, sample_bytes: int = 64 << 20, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with lang_pred, score and known, under the names ``added``; the model learns from text and lang of the rows where ``learn`` holds."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, learn, per_language, sample_bytes)))
    fields = [f for f in docs.schema.fields if f.name.lower() not in {a.lower() for a in added}]
    schema = T.StructType([*fields, *(T.StructField(a, kind) for a, kind in zip(added, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from identified(batches, shared.value, schema.names)

    return docs.select(*(quoted(f.name).alias("text" if f.name == "text" else f"c{i}") for i, f in enumerate(fields))).mapInArrow(run, schema)
