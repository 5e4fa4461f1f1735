import random

import pytest

from trackloom.llm import chosen_path

from data import ODD, documents


def sets(text, size=5):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, threshold=0.8):
    s = [sets(t) for _, t, *_ in rows]
    near = [[i != j and bool(a) and len(a & b) >= threshold * len(a | b) - 1e-9 for j, b in enumerate(s)] for i, a in enumerate(s)]
    ids = [r[0] for r in rows]
    comp = list(ids)
    low = lambda xs: min((x for x in xs if x is not None), default=None)
    while True:
        new = [low([comp[i], *(comp[j] for j in range(len(ids)) if near[i][j])]) for i in range(len(ids))]
        if new == comp:
            return sorted(((i, c, sum(n)) for i, c, n in zip(ids, comp, near, strict=True)), key=repr)
        comp = new


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(12):
        text = [word() for _ in range(r.randint(4, 90))]
        if g % 3 == 0:
            text += passage
        for _ in range(r.choice([1, 1, 2, 5, 40])):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = word()
            rows.append((1000 + len(rows), " ".join(copy), "en", "s", 0, 0.5, 1))
    return rows


@pytest.mark.parametrize("options", [{}, {"leaf": 4, "block": 8}])
def test_like_brute_force(spark, options):
    rows = corpus() + [r for r in ODD if r[0] != 8] + [(8, "word " * 4000, "en", "s", 0, 0.5, 1), (10, "Word " * 70, "en", "s", 0, 0.5, 1)]
    got = sorted(map(tuple, chosen_path.join(documents(spark, rows), **options).collect()), key=repr)
    assert got == brute(rows)


def test_no_documents_and_no_words(spark):
    assert chosen_path.join(documents(spark, [])).count() == 0
    assert sorted(map(tuple, chosen_path.join(documents(spark, ODD[1:4])).collect())) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]


def thue_morse(k, swapped=False):
    s = "a"
    for _ in range(k):
        s = "".join("ab" if c == "a" else "ba" for c in s)
    return s.translate(str.maketrans("ab", "ba")) if swapped else s


def test_rows_without_ids_and_twin_words(spark):
    text = [f"w{i}" for i in range(60)]
    near = " ".join([*text[:-1], "other"])
    rows = [(4, " ".join(text), "en", "s", 0, 0.5, 1), (None, near, "en", "s", 0, 0.5, 1), (None, near, "en", "s", 0, 0.5, 1), (None, "no link here", "en", "s", 0, 0.5, 1)]
    rows += [(20 + 2 * k + s, thue_morse(k, s), "en", "s", 0, 0.5, 1) for k in (10, 11, 12) for s in (0, 1)]
    got = sorted(map(tuple, chosen_path.join(documents(spark, rows)).collect()), key=repr)
    assert got == brute(rows) and (4, 4, 2) in got and (None, 4, 2) in got and (None, None, 0) in got
    same = [(5, f"{i} " + " ".join(text), "en", "s", 0, 0.5, 1) for i in (1, 2, 2)] * 3  # one id, several texts, repeated rows
    assert sorted(map(tuple, chosen_path.join(documents(spark, same)).collect())) == [(5, 5, 8)] * 9
