"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has a model of words given the word before. It interpolates, with Kneser-Ney discounts, the class's
continuation counts of word pairs and of words (different words that come before), and below these the continuation counts that both
classes share. A word that neither class knows is spelt by letters (bytes): each from up to ``ORDER`` bytes before it in the word by the
class's continuation counts, backing off to counts of shorter contexts that both classes share. Continuation counts are used at every
order, the highest too, so that a passage that is copied into many texts of a class counts once and not as evidence. The class's own
counts are discounted by ``OWN_DISCOUNT``: a pair or word found in no more contexts than that is left to what the classes share.

A text is judged by its length-normalised log-likelihood under the toxic model less that under the ordinary one: over the whole text, and
over every window of ``WINDOW`` words, of which the largest counts, as a short toxic passage would be lost in the mean of a long text.
Both differences go through a logistic curve, fitted by cross-fitting: each of ``FOLDS`` parts of the sample is scored by models of the
others.

Words are runs of ASCII letters, digits and bytes of other alphabets, lower-cased where ASCII, known by 64-bit hashes. The sample is
bounded: at most ``per_class`` labelled texts of each class, those of least hash of their id and text, and of those at most
``sample_bytes`` bytes, whole texts only; of several labels of a document the largest counts. Scoring reads whole texts of all rows, in
double precision throughout, so that a score does not depend on what a worker read before. Null or empty texts, and texts without words,
have no evidence: their score is the curve's at difference 0, and at most 0.5. With only one class, or no labels, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import chunks, lowered, mix, slice_hashes, string_column
from .bpe import gather
from .langid import Index

ORDER, WINDOW, FOLDS = 6, 3, 5
DISCOUNT, OWN_DISCOUNT = 0.9, 3
START = np.uint64(0x5DEECE66D1234567)
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words of texts at offsets ``at``."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = _INSIDE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


class Table:
    """Sums by 64-bit key; 0 for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        known, back = np.unique(keys, return_inverse=True)
        self.index, self.values = Index(known), np.concatenate(([0.0], np.bincount(back, values, len(known))))

    def get(self, keys: np.ndarray) -> np.ndarray:
        return self.values[self.index(keys)]


class Grams:
    """Discounted counts of a byte after a context."""

    def __init__(self, context: np.ndarray, gram: np.ndarray, n: np.ndarray) -> None:
        self.gram, self.total = Table(gram, n), Table(context, n)
        seen, first = np.unique(gram, return_index=True)
        self.kinds = Table(context[first], np.ones(len(seen)))

    def smoothed(self, context: np.ndarray, gram: np.ndarray, below: np.ndarray) -> np.ndarray:
        total = self.total.get(context)
        some = np.maximum(total, 1)
        return np.where(total > 0, np.maximum(self.gram.get(gram) - DISCOUNT, 0) / some + DISCOUNT * self.kinds.get(context) / some * below, below)


CONTEXTS = (ORDER, 3, 1)


def groups(length: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, place) of every letter and end of words of such lengths, about ``most`` at a time; a longer word is cut by itself."""
    upto = np.concatenate(([0], np.cumsum(length + 1)))
    first = 0
    while first < len(length):
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + most, "right")) - 1)
        for k in range(0, int(upto[end] - upto[first]), most) if end == first + 1 else (0,):
            last = min(int(upto[end] - upto[first]), k + most) if end == first + 1 else int(upto[end] - upto[first])
            word = np.repeat(np.arange(first, end), length[first:end] + 1)[k:last]
            yield word, np.arange(k, last) + upto[first] - upto[word]
        first = end


def letters(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """For letters and ends of words: whose word they are, and the keys of contexts and grams by decreasing context length."""
    for word, place in groups(ends - starts):
        at = starts[word] + place
        letter = lambda back: np.where(at - back < ends[word], raw[np.minimum(at - back, len(raw) - 1)], 0).astype(np.uint64) + np.uint64(1)  # noqa: B023, E731
        byte, contexts, grams = letter(0), [], []
        with np.errstate(over="ignore"):
            for size in CONTEXTS:
                key = 7 + size + 1000 * (place < size).astype(np.uint64)  # a shorter context starts at the word's start
                for back in range(size, 0, -1):
                    key = np.where(place >= back, mix(key * np.uint64(1099511628211) + letter(back)), key)
                contexts.append(key)
                grams.append(mix(key * np.uint64(31) + byte))
        yield word, contexts, grams


def tallied(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[np.ndarray]]:
    """[contexts, grams, counts] for each context length: each group of words is reduced to distinct grams before the next is read."""
    parts: list[list[tuple[np.ndarray, ...]]] = [[], [], []]
    for _, contexts, grams in letters(raw, starts, ends):
        for i, part in enumerate(parts):
            gram, first, n = np.unique(grams[i], return_index=True, return_counts=True)
            part.append((contexts[i][first], gram, n))
    none = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    return [[np.concatenate([p[j] for p in part] or [none[j]]) for j in range(3)] for part in parts]


def pairs(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word before each word, the pair's key); the first word of a text follows the start."""
    before = np.concatenate(([START], keys[:-1]))
    before[np.concatenate(([True], row[1:] != row[:-1]))] = START
    with np.errstate(over="ignore"):
        return before, mix(before * np.uint64(0x9E3779B97F4A7C15) + keys)


class Counts:
    """Values of two classes by 64-bit key; a key that neither has gives zeros."""

    def __init__(self, by_class: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys = np.unique(np.concatenate([k for k, _ in by_class]))
        self.index, self.values = Index(keys), np.zeros((2, len(keys) + 1))
        for c, (k, n) in enumerate(by_class):
            self.values[c, 1 + np.searchsorted(keys, k)] = n

    def get(self, keys: np.ndarray) -> np.ndarray:
        return self.values[:, self.index(keys)]


@dataclass
class Model:
    pair: Counts  # different words before a pair
    context: Counts  # the same, summed over the words that follow
    left: Counts  # of these, what the discount leaves to words alone
    word: Counts  # different words before a word
    total: np.ndarray  # different pairs of each class
    share: np.ndarray  # of these, what the discount leaves to letters
    own: list[Grams]
    shared: list[Grams]
    curve: np.ndarray  # weights of whole and window difference, bias

    def alone(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """(2, words): the probability of words by class, whatever comes before."""
        spelt = np.zeros((2, len(starts)))
        for word, contexts, grams in letters(raw, starts, ends):
            below = np.full(len(word), 1 / 220)
            for level in (1, 0):
                below = self.shared[level].smoothed(contexts[level + 1], grams[level + 1], below)
            for c in (0, 1):
                logs = np.bincount(word - word[0], np.log(self.own[c].smoothed(contexts[0], grams[0], below)))
                spelt[c, word[0] : word[-1] + 1] += logs
        spelt = np.exp(np.maximum(spelt, -600))
        return np.maximum(self.word.get(keys) - OWN_DISCOUNT, 0) / self.total[:, None] + self.share[:, None] * spelt

    def ratios(self, before: np.ndarray, pair: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """log P(word | word before, toxic) - log P(word | word before, ordinary)."""
        n = self.context.get(before)
        some = np.maximum(n, 1)
        p = np.where(n > 0, np.maximum(self.pair.get(pair) - OWN_DISCOUNT, 0) / some + self.left.get(before) / some * alone, alone)
        return np.log(np.maximum(p[1], 1e-290)) - np.log(np.maximum(p[0], 1e-290))


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """Each chunk of texts is reduced to its distinct pairs and words by class before the next is read."""
    pieces: list[list[tuple[np.ndarray, ...]]] = [[], []]
    spelt: list[list[tuple[np.ndarray, ...]]] = [[], []]
    for first, _, raw, at in chunks(pa.array(texts, pa.large_string())):
        raw = lowered(raw)
        s, e, row = spans(raw, at)
        keys, label = slice_hashes(raw, s, e), toxic[first + row]
        if not len(keys):
            continue
        before, pair = pairs(keys, row)
        three = pairs(pair, row)[1]
        for c in (0, 1):
            own = np.flatnonzero(label == c)
            kind, where = np.unique(three[own], return_index=True)
            pieces[c].append((kind, pair[own[where]], before[own[where]], keys[own[where]]))
            word, where = np.unique(keys[own], return_index=True)
            size = (e - s)[own[where]]
            spelt[c].append((word, size, gather(raw, s[own[where]], size)[0]))
    by_class, own_grams, pooled = [], [], []
    none = np.zeros(0, np.uint64)
    for c in (0, 1):
        column = lambda i: np.concatenate([p[i] for p in pieces[c]] or [none])  # noqa: B023, E731
        once = np.unique(column(0), return_index=True)[1]
        kind, where, count = np.unique(column(1)[once], return_index=True, return_counts=True)
        once = once[where]
        by_class.append((kind, count, column(2)[once], column(3)[once]))
        pieces[c].clear()
        keys, size, raw = (np.concatenate([p[i] for p in spelt[c]] or [none.astype(t)]) for i, t in enumerate((np.uint64, np.int64, np.uint8)))
        where = np.unique(keys, return_index=True)[1]
        end = np.cumsum(size)[where]
        counts = tallied(raw, end - size[where], end)
        own_grams.append(Grams(*counts[0]))
        pooled.append(counts[1:])
    several = [(k[n > OWN_DISCOUNT], n[n > OWN_DISCOUNT]) for k, n, _, _ in by_class]  # others have nothing left after the discount
    context, left, word = [], [], []
    for _, n, before, w in by_class:
        k, back = np.unique(before, return_inverse=True)
        context.append((k, np.bincount(back, n, len(k))))
        left.append((k, np.bincount(back, np.minimum(n, OWN_DISCOUNT), len(k))))
        word.append(np.unique(w, return_counts=True))
    shared = [Grams(*(np.concatenate([p[i][j] for p in pooled]) for j in range(3))) for i in (0, 1)]
    total = np.array([max(1.0, len(b[0])) for b in by_class])
    share = np.array([np.minimum(n, OWN_DISCOUNT).sum() for _, n in word]) / total
    return Model(Counts(several), Counts(context), Counts(left), Counts(word), total, share, own_grams, shared, np.zeros(3))


class Scorer:
    """Differences of texts; probabilities of words are kept in a cache of bounded size."""

    def __init__(self, model: Model, cache: int = 400_000) -> None:
        self.model, self.limit = model, cache
        self.forget()

    def forget(self) -> None:
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((2, 0))

    def alone(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The probabilities of distinct, sorted words."""
        i = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        hit = self.keys[i] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.empty((2, len(keys)))
        out[:, hit] = self.values[:, i[hit]]
        new = np.flatnonzero(~hit)
        out[:, new] = self.model.alone(raw, s[new], e[new], keys[new])
        if len(self.keys) + len(new) <= self.limit:
            at = np.searchsorted(self.keys, keys[new])
            self.keys, self.values = np.insert(self.keys, at, keys[new]), np.insert(self.values, at, out[:, new], 1)
        return out

    def differences(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, 2): the length-normalised difference over the text, and the largest over a window."""
        raw = lowered(raw)
        s, e, row = spans(raw, at)
        out = np.zeros((len(at) - 1, 2))
        if not len(s):
            return out
        hashed = slice_hashes(raw, s, e)
        keys, where, back = np.unique(hashed, return_index=True, return_inverse=True)
        r = self.model.ratios(*pairs(hashed, row), self.alone(raw, s[where], e[where], keys)[:, back])
        n = np.bincount(row, minlength=len(out))
        out[:, 0] = np.bincount(row, r, len(out)) / np.maximum(n, 1)
        # every window is summed by itself, so that a text's sums do not depend on the texts beside it
        begin = np.concatenate(([0], np.cumsum(n)))[row]
        place = np.arange(len(r)) - begin
        total, held = r.copy(), np.ones(len(r))
        for k in range(1, WINDOW):
            inside = place >= k
            total[inside] += r[np.flatnonzero(inside) - k]
            held += inside
        whole = place >= np.minimum(WINDOW, n[row]) - 1
        best = np.full(len(out), -np.inf)
        np.maximum.at(best, row[whole], (total / held)[whole])
        out[:, 1] = np.where(n > 0, best, 0)
        return out


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve by Newton steps with a small ridge, classes weighted alike."""
    a = np.column_stack((x, np.ones(len(x))))
    w, weight = np.zeros(a.shape[1]), np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum()))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + 1e-4 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def all_differences(model: Model, texts: list[str]) -> np.ndarray:
    scorer = Scorer(model)
    return np.concatenate([scorer.differences(raw, at) for _, _, raw, at in chunks(pa.array(texts, pa.large_string()), 1 << 20)])


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """A model from (text, toxic) pairs; None unless both classes are there."""
    texts, toxic = [t for t, _ in rows], np.array([y for _, y in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    rank = np.zeros(len(toxic), int)
    for c in (0, 1):
        rank[toxic == c] = np.arange((toxic == c).sum())
    x, y = [], []
    for part in range(FOLDS):  # one model at a time is held
        a, b = np.flatnonzero(rank % FOLDS != part), np.flatnonzero(rank % FOLDS == part)
        if len(set(toxic[a].tolist())) == 2 and len(b):
            x.append(all_differences(train([texts[i] for i in a], toxic[a]), [texts[i] for i in b]))
            y.append(toxic[b])
    model = train(texts, toxic)
    if not x:
        x, y = [all_differences(model, texts)], [toxic]
    model.curve = logistic(np.concatenate(x), np.concatenate(y))
    return model


def curve(model: Model, d: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Scores by differences and numbers of words."""
    p = 1 / (1 + np.exp(-np.clip(d @ model.curve[:-1] + model.curve[-1], -30, 30)))
    return np.where(words > 0, p, np.minimum(p, 0.5))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int, sample_bytes: int) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled texts of each class among the rows to learn from, by the hash of their ids and texts."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(learn)
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    share = F.when(F.col("toxic") == 1, int(min(1.0, 0.95 * per_class / max(1, counts.get(1, 0))) * (1 << 30))).otherwise(int(min(1.0, 0.95 * per_class / max(1, counts.get(0, 0))) * (1 << 30)))
    chosen = known.where(order < share).select("doc_id", "toxic", order.alias("o")).orderBy("o", "doc_id").limit(3 * per_class)
    rank = Window.partitionBy("toxic").orderBy("o", "doc_id", "t")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t")).join(F.broadcast(chosen), "doc_id")
    first = rows.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= per_class)
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(rank.rowsBetween(Window.unboundedPreceding, 0))
    found = first.withColumn("upto", size).where(F.col("upto") <= sample_bytes // 2).select("o", "doc_id", "t", "text", "toxic").collect()
    return [(r.text or "", r.toxic) for r in sorted(found, key=lambda r: (r.o, r.doc_id, r.t))]


def score(docs: DataFrame, labels: DataFrame, learn: Column, held_out: Column, threshold: float = 0.7, per_class: int = 3000, sample_bytes: int = 128 << 20) -> DataFrame:
    """doc_id, held_out, score and predicted of every text; ``learn`` is a condition on the labels' doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, learn, per_class, sample_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model else None
        for batch in batches:
            found = [
                curve(model, scorer.differences(raw, at), np.bincount(spans(raw, at)[2], minlength=len(at) - 1)) if model else np.zeros(len(at) - 1)
                for _, _, raw, at in chunks(string_column(batch, "text"))
            ]
            p = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
