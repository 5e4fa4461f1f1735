import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from trackloom.llm import toxicity
from trackloom.llm._common import buffers
from trackloom.llm.queries import QUERIES

from data import documents


def corpus(n=240):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "st"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        text, bad = [word() for _ in range(r.randint(5, 60))], int(i % 4 == 0)
        for _ in range(3 * bad):
            text[r.randrange(len(text))] = r.choice(["vequ", "vequ", "zor"]) + r.choice(["mo", "ta", "ique", "an", "is"])
        rows.append((i, " ".join(text), "en", "s", 0, 0.5, 1))
        labels.append((i, bad, "clash"))
    return rows, labels


def run(spark, rows, labels, learn="doc_id % 2 = 0"):
    table = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    return toxicity.score(documents(spark, rows), table, F.expr(learn), F.col("doc_id") % 2 == 1)


def test_finds_expressions_it_has_only_seen_in_part(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in run(spark, rows, labels).collect()}
    right = [got[i].predicted == bad for i, bad, _ in labels if i % 2]
    assert sum(right) / len(right) > 0.9 and all(0 <= r.score <= 1 and (r.predicted == (r.score >= 0.7)) for r in got.values())


def test_odd_rows(spark):
    rows, labels = corpus()
    from data import ODD

    odd = [(None if r[0] is None else 1000 + r[0], *r[1:]) for r in ODD]
    got = [r for r in run(spark, rows + odd, [*labels, (3, None, ""), (None, 1, ""), (5, 0, ""), (5, 1, ""), (7, 9, "")]).collect() if r.doc_id is None or r.doc_id >= 1000]
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (1001, 1002, 1003))


def test_nothing_to_learn_from(spark):
    rows, labels = corpus(12)
    assert {r.score for r in run(spark, rows, labels, "false").collect()} == {0.0}
    assert {r.score for r in run(spark, rows, [x for x in labels if x[1] == 0]).collect()} == {0.0}
    assert run(spark, [], labels).count() == 0


def test_held_out_accuracy_on_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    got = QUERIES["op3_toxicity"](spark, d).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in got}
    assert share[1] > 0.8 and share[0] < 0.03


def plain(texts, toxic):
    """The two models by dictionaries; gives log P(word | before, toxic) - log P(word | before, ordinary)."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\xff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().decode("latin-1"))
    three = [{(a, b, c) for t, y in zip(texts, toxic, strict=True) if y == k for w in [words(t)] for a, b, c in zip(["", "", *w], ["", *w], w)} for k in (0, 1)]  # noqa: B905
    grams = lambda ws, n: {(w[max(0, i - n) : i], min(i, n) < n, w[i : i + 1], w) for w in ws for i in range(len(w) + 1)}

    def letter_counts(by_class, n):
        held = [(x[:3], x[3], k) for k, ws in enumerate(by_class) for x in grams(ws, n)]
        gram = Counter(g for g, _, _ in set(held))
        for k, ws in enumerate(by_class):  # a letter twice after the same context in a word counts twice
            for w in ws:
                seen = Counter((w[max(0, i - n) : i], min(i, n) < n, w[i : i + 1]) for i in range(len(w) + 1))
                for g, c in seen.items():
                    gram[g] += c - 1
        total, kinds = Counter(), Counter()
        for (a, b, _), c in gram.items():
            total[a, b] += c
            kinds[a, b] += 1
        return gram, total, kinds

    vocabulary = [{c for _, _, c in x} for x in three]
    own = [letter_counts([v], toxicity.ORDER) for v in vocabulary]
    shared = [letter_counts(vocabulary, n) for n in (3, 1)]

    def smoothed(counts, w, i, n, below):
        gram, total, kinds = counts
        key = (w[max(0, i - n) : i], min(i, n) < n)
        d = toxicity.DISCOUNT
        return (max(gram[(*key, w[i : i + 1])] - d, 0) + d * kinds[key] * below) / total[key] if total[key] else below

    def spelt(w, k):
        out = 1.0
        for i in range(len(w) + 1):
            p = 1 / 220
            p = smoothed(shared[1], w, i, 1, p)
            p = smoothed(shared[0], w, i, 3, p)
            out *= smoothed(own[k], w, i, toxicity.ORDER, p)
        return out

    D = toxicity.OWN_DISCOUNT
    pair = [Counter((b, c) for _, b, c in x) for x in three]
    word = [Counter(c for _, c in p) for p in pair]

    def p(k, before, w):
        total = max(1, len(pair[k]))
        alone = max(word[k][w] - D, 0) / total + sum(min(n, D) for n in word[k].values()) / total * spelt(w, k)
        after = {c: n for (b, c), n in pair[k].items() if b == before}
        some = sum(after.values())
        return (max(after.get(w, 0) - D, 0) + sum(min(n, D) for n in after.values()) * alone) / some if some else alone

    def both(t):
        w = words(t)
        r = [math.log(p(1, b, x)) - math.log(p(0, b, x)) for b, x in zip(["", *w], w)]  # noqa: B905
        size = min(toxicity.WINDOW, len(r))
        return [sum(r) / len(r), max(sum(r[i : i + size]) / size for i in range(len(r) - size + 1))] if r else [0.0, 0.0]

    return both


def test_like_plain_counts():
    rows, labels = corpus(60)
    texts, toxic = [t for _, t, *_ in rows] + ["Été naïve-3 vequmo vequmo", ""], np.array([y for _, y, _ in labels] + [1, 0])
    model, both = toxicity.train(texts, toxic), plain(texts, toxic)
    new = [t for _, t, *_ in corpus(70)[0][60:]] + ["vequmo", "zor vequta the", "", "été qqq"]
    got = toxicity.all_differences(model, new)
    np.testing.assert_allclose(got, [both(t) for t in new], rtol=1e-9, atol=1e-9)
    scorer = toxicity.Scorer(model, 5)  # neither the cache nor neighbours change a score
    for t, want in zip(new, got, strict=True):
        raw, at = buffers(pa.array([t], pa.large_string()))
        np.testing.assert_allclose(scorer.differences(raw, at)[0], want, rtol=1e-12)
