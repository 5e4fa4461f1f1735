"""Personal data by a character-level bidirectional LSTM with CRF transitions, over a base of patterns.

Base patterns find e-mail addresses, IP addresses, card numbers (13 to 19 digits that pass Luhn) and phone numbers (9 to 15 digits),
leftmost and without overlap within a kind; matches that fail their test are dropped. The model adds spans that the patterns miss:
numbers and addresses written otherwise (dots or slashes between a card's digits, phone numbers without a plus, ``[.]``, ``[at]`` or
``(dot)`` in addresses). It reads each character's class and shape (about thirty symbols), runs an LSTM in both directions and
decodes the best path of tags (begin and inside of each kind, and outside) under learned transitions.

It is trained in numpy, by gradient descent on the CRF's likelihood with back-propagation through time, from labelled spans: sentences
of a seeded generator whose spans are known. Training takes some seconds on the driver, and the model is a few kilobytes.

Every character of every text is read, in windows of ``READ`` characters that start every ``STRIDE``: what two windows both read is taken
from the one that sees more on both sides, ``MARGIN`` characters at least. So windows are reconciled into one row of emissions a text, and
one best path through the whole text is decoded, whatever windows a span crosses. Most of the path is proven instead of searched: a run
of tags can only be better than outside if its emissions' gains, less what the transitions can at most give back, add up to more than
nothing, and only characters that lie in some such run are searched (``possible``); the path is that of the plain search. A span must
pass its kind's own test (``plausible``), and must not overlap a base span or an earlier span of the model's.

Null texts count as empty and have no spans. Texts of any length are read whole, in time linear in their length; positions are code
points. Repeated rows stand alone; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, quoted, string_column

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW = 64  # of training
READ, MARGIN = 1024, 32
STRIDE = READ - 2 * MARGIN
HIDDEN, EMBED = 12, 8
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # an address starts where the characters allowed before its sign do, or where the last one ended
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            last = m.end()
        else:
            last = at + 1  # no address crosses a sign
        at = text.find("@", last)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


def _alphabet() -> np.ndarray:
    """The symbol of each code point below 128: white space, signs each their own, digits, vowels and others of either case; above: 0."""
    table = np.zeros(128, np.int64)
    names: dict[str, int] = {}
    for c in range(128):
        x = chr(c)
        name = "digit" if x.isdigit() else ("vowel" if x in "aeiou" else "lower") if x.islower() else "upper" if x.isupper() else "blank" if x.isspace() else x if x in "@.-()+_/:,%[]#" else "sign"
        table[c] = 1 + names.setdefault(name, len(names))
    return table


ALPHABET = _alphabet()
SYMBOLS = int(ALPHABET.max()) + 1


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, ALPHABET[np.minimum(points, 127)], 0)


@dataclass
class Model:
    embed: np.ndarray  # (SYMBOLS, EMBED)
    wx: np.ndarray  # (2, EMBED, 4 HIDDEN): for both directions
    wh: np.ndarray
    b: np.ndarray
    out: np.ndarray  # (2 HIDDEN, TAGS)
    out_b: np.ndarray
    moves: np.ndarray  # (TAGS, TAGS)
    start: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.wx, self.wh, self.b, self.out, self.out_b, self.moves, self.start]


def fresh(seed: int = 1) -> Model:
    r = np.random.default_rng(seed)
    w = lambda *s: (r.normal(size=s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
    b = np.zeros((2, 4 * HIDDEN), np.float32)
    b[:, HIDDEN : 2 * HIDDEN] = 3
    return Model(0.5 * w(SYMBOLS, EMBED) * np.sqrt(SYMBOLS).astype(np.float32), w(2, EMBED, 4 * HIDDEN), w(2, HIDDEN, 4 * HIDDEN), b, w(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), forbidden(), np.where(np.arange(TAGS) % 2 == 0, np.where(np.arange(TAGS) > 0, -8, 0), 0).astype(np.float32))


def forbidden() -> np.ndarray:
    """Transitions to start from: an inside tag follows only its own kind. Tags: 0 outside, 2k + 1 begin, 2k + 2 inside."""
    m = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        m[:, 2 * k + 2] = -8
        m[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 0
    return m


def _bent(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): what stands for the hyperbolic tangent here, as it needs no exponential; (1 + it) / 2 is a gate's opening."""
    return x / (1 + np.abs(x))


def forward(model: Model, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """(steps, rows, TAGS) emissions of symbols (rows, steps); with what back-propagation needs."""
    n, steps = x.shape
    e = model.embed[x.T]
    states, memory = np.empty((steps, n, 2 * HIDDEN), np.float32), []
    for d in (0, 1):
        gates = e @ model.wx[d] + model.b[d]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        kept = []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z = gates[t] + h @ model.wh[d]
            s = _bent(z)
            g = s[:, 3 * HIDDEN :]
            i, f, o = ((1 + s[:, k * HIDDEN : (k + 1) * HIDDEN]) / 2 for k in range(3))
            before, old = h, c
            c = f * c + i * g
            tc = _bent(c)
            h = o * tc
            states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
            if keep:
                kept.append((t, before, old, i, f, o, g, tc))
        memory.append(kept)
    return states @ model.out + model.out_b, [e, states, memory]


def crf_gradient(model: Model, scores: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood and its gradients by emissions, transitions and start scores."""
    steps, n, _ = scores.shape
    scores = scores.astype(np.float64)
    moves, rows = model.moves.astype(np.float64), np.arange(n)

    def lse(v: np.ndarray, axis: int) -> np.ndarray:
        m = v.max(axis, keepdims=True)
        return (m + np.log(np.exp(v - m).sum(axis, keepdims=True))).squeeze(axis)

    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = model.start + scores[0]
    for t in range(1, steps):
        alpha[t] = lse(alpha[t - 1][:, :, None] + moves, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = lse(moves[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    z = lse(alpha[-1], 1)
    gold = model.start[tags[0]] + scores[0, rows, tags[0]]
    d_scores = np.exp(alpha + beta - z[None, :, None])
    d_moves = np.zeros_like(moves)
    d_start = d_scores[0].sum(0)
    np.add.at(d_start, tags[0], -1.0)
    for t in range(steps):
        d_scores[t, rows, tags[t]] -= 1
        if t:
            gold = gold + moves[tags[t - 1], tags[t]] + scores[t, rows, tags[t]]
            d_moves += np.exp(alpha[t - 1][:, :, None] + moves + (scores[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(d_moves, (tags[t - 1], tags[t]), -1.0)
    return float((z - gold).mean()), (d_scores / n).astype(np.float32), (d_moves / n).astype(np.float32), (d_start / n).astype(np.float32)


def gradients(model: Model, x: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    scores, (e, states, memory) = forward(model, x, True)
    loss, ds, d_moves, d_start = crf_gradient(model, scores, tags.T)
    d_states = ds @ model.out.T
    d_e, d_wx, d_wh, d_b = np.zeros_like(e), np.zeros_like(model.wx), np.zeros_like(model.wh), np.zeros_like(model.b)
    for d in (0, 1):
        dh_next = dc_next = np.zeros((x.shape[0], HIDDEN), np.float32)
        for t, before, old, i, f, o, g, tc in reversed(memory[d]):
            dh = d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN] + dh_next
            dc = dc_next + dh * o * (1 - np.abs(tc)) ** 2
            opens = lambda x: (1 - np.abs(2 * x - 1)) ** 2 / 2
            dz = np.concatenate((dc * g * opens(i), dc * old * opens(f), dh * tc * opens(o), dc * i * (1 - np.abs(g)) ** 2), 1)
            d_wh[d] += before.T @ dz
            d_wx[d] += e[t].T @ dz
            d_b[d] += dz.sum(0)
            d_e[t] += dz @ model.wx[d].T
            dh_next, dc_next = dz @ model.wh[d].T, dc * f
    d_embed = np.zeros_like(model.embed)
    np.add.at(d_embed, x.T, d_e)
    return loss, [d_embed, d_wx, d_wh, d_b, np.tensordot(states, ds, ((0, 1), (0, 1))), ds.sum((0, 1)), d_moves, d_start]


def viterbi(model: Model, scores: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """(rows, steps) best tags; ``first``: what each row's first tag is worth, the model's start by default."""
    steps, n, _ = scores.shape
    best, back = (model.start if first is None else first) + scores[0], np.empty((steps, n, TAGS), np.int8)
    for t in range(1, steps):
        every = best[:, :, None] + model.moves
        back[t] = every.argmax(1)
        best = every.max(1) + scores[t]
    out = np.empty((n, steps), np.int8)
    out[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(n), out[:, t]]
    return out


class Network:
    """The model's emissions of many windows at once; each gate has its own table by symbol and its own rows, so that all steps are on whole arrays."""

    def __init__(self, model: Model) -> None:
        cut = lambda w, d: [np.ascontiguousarray(w[..., k * HIDDEN : (k + 1) * HIDDEN], np.float32) for k in range(4)]
        self.table = [cut(model.embed @ model.wx[d] + model.b[d], d) for d in (0, 1)]
        self.wh = [cut(model.wh[d], d) for d in (0, 1)]
        self.out = [np.ascontiguousarray(model.out[d * HIDDEN : (d + 1) * HIDDEN]) for d in (0, 1)]
        self.bias = model.out_b.astype(np.float32)

    def emissions(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(steps, rows, TAGS) for symbols (steps, rows); rows come by decreasing length, and beyond its length a row means nothing."""
        steps, n = x.shape
        out = np.empty((steps, n, TAGS), np.float32)
        out[:] = self.bias
        active = np.searchsorted(-length, -np.arange(steps), "left")  # rows longer than t

        def bend(v: np.ndarray, room: np.ndarray) -> None:
            np.abs(v, out=room)
            room += 1
            v /= room

        for d in (0, 1):
            h, c, room = (np.zeros((n, HIDDEN), np.float32) for _ in range(3))
            (ti, tf, to, tg), (wi, wf, wo, wg) = self.table[d], self.wh[d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                m = active[t]
                row, hm, cm, r = x[t, :m], h[:m], c[:m], room[:m]
                i, f, o, g = ti.take(row, 0), tf.take(row, 0), to.take(row, 0), tg.take(row, 0)
                for gate, w in ((i, wi), (f, wf), (o, wo), (g, wg)):
                    np.matmul(hm, w, out=r)
                    gate += r
                    bend(gate, r)
                i += 1
                i *= g
                f += 1
                cm *= f
                cm += i
                cm *= 0.5
                np.copyto(g, cm)
                bend(g, r)
                o += 1
                o *= g
                np.multiply(o, 0.5, out=hm)
                out[t, :m] += hm @ self.out[d]
        return out


def windows_of(length: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) of a text's windows: each stands for the characters from first to last."""
    n = max(1, -(-(length - READ) // STRIDE) + 1)
    return [(k * STRIDE, min(length, k * STRIDE + READ), k * STRIDE + MARGIN if k else 0, (k + 1) * STRIDE + MARGIN if k < n - 1 else length) for k in range(n)] if length else []


def possible(begin: np.ndarray, go_on: np.ndarray, end: float, block: int = 1 << 16) -> np.ndarray:
    """Which positions lie in a run of tags that could be worth more than staying outside, but for rounding.

    A run is worth at most ``begin`` of its first position, ``go_on`` of each further one, and ``end``.
    """
    n = len(begin)
    left, right = np.empty(n, np.float32), np.empty(n, np.float32)
    carry = -np.inf
    for k in range(0, n, block):  # the best run so far that ends here
        upto = np.cumsum(go_on[k : k + block], dtype=np.float64)
        best = np.maximum.accumulate(begin[k : k + block] - upto)
        left[k : k + block] = upto + np.maximum(best, carry)
        carry = float(left[min(n, k + block) - 1])
    carry = 0.0
    for k in reversed(range(0, n, block)):  # the best that can follow
        upto = np.cumsum(go_on[k : k + block], dtype=np.float64)
        best = np.maximum.accumulate(upto[::-1])[::-1]
        right[k : k + block] = np.maximum(best, upto[-1] + carry) - upto
        carry = max(0.0, float(go_on[k] + right[k]))
    return left + right + end >= -1e-3


def labelled(r: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence of the generator, with its spans."""
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    word = lambda: "".join(pick(["th", "er", "on", "an", "re", "st", "en", "la", "que", "é", "ü", "ung", "ción", "a", "i", "o"]) for _ in range(int(r.integers(1, 5))))
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))

    def card() -> str:
        d = pick("3456") + digits(int(pick([12, 14, 14, 14, 14])))
        d += next(c for c in "0123456789" if luhn(d + c))
        s = pick(["", " ", "-", ".", "/", "_"])
        return s.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{digits(2)} {a} {b} {c}", f"+1.{a}.{b}.{c}"])

    def email() -> str:
        name, host, end = word() + pick([".", "_", "", "-"]) + digits(int(r.integers(0, 3))), word() + pick(["", digits(1)]), pick(["com", "org", "net", "example.com"])
        name = "".join(c for c in name if c.isascii()) or "a"
        host = "".join(c for c in host if c.isascii()) or "b"
        return pick([f"{name}@{host}.{end}", f"{name}@{host}.{end}", f"{name} @ {host}.{end}", f"{name}@{host} . {end}", f"{name}@{host}[.]{end}", f"{name}[at]{host}.{end}", f"{name} (at) {host}(dot){end}"])

    ip = lambda: ".".join(str(x) for x in r.integers(0, 256, 4))
    odd = lambda: pick([f"ip:{ip()}", ip(), ip().replace(".", "[.]")])
    plain = lambda: pick([digits(int(r.integers(1, 9))), f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"AKIA{digits(6)}QX{digits(2)}", f"pass={digits(5)}b7{digits(3)}a", f"@{word()}", f"${digits(3)}.{digits(2)}", f"{digits(1)},{digits(3)}", f"{digits(2)}:{digits(2)}", f"{word()}{digits(2)}", digits(int(r.integers(20, 30)))])
    text, spans = word() + " ", []
    prose, marks = r.random() < 0.4, r.random() < 0.25  # words alone; words with signs, as tables and junk have them
    while len(text) < WINDOW + 24:
        u = r.random()
        if prose or u < 0.45:
            text += pick([word, word, word, lambda: word().title(), lambda: "".join(map(chr, r.integers(97, 123, int(r.integers(1, 10)))))])()
            text += pick(["%%%", "###", "***", "$$$", "&&&", " |", "!", "?", ";", "'s", "-" + word(), "..."]) if marks else ""
        elif u < 0.65:
            text += plain()
        else:
            kind = int(r.integers(0, 4))
            s = (email, odd, card, phone)[kind]()
            text += "ip:" if s.startswith("ip:") else ""
            s = s.removeprefix("ip:")
            spans.append((kind, len(text), len(text) + len(s)))
            text += s
        text += pick([" ", " ", " ", " ", ", ", ". ", ".\n", "\n"])
    return text, spans


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of windows cut from labelled sentences."""
    r = np.random.default_rng(seed)
    x, y = np.empty((n, WINDOW), np.int64), np.empty((n, WINDOW), np.int64)
    for i in range(n):
        text, spans = labelled(r)
        tags = np.zeros(len(text), np.int64)
        for k, a, b in spans:
            tags[a], tags[a + 1 : b] = 2 * k + 1, 2 * k + 2
        first = int(r.integers(0, len(text) - WINDOW + 1))
        x[i], y[i] = symbols(text)[first : first + WINDOW], tags[first : first + WINDOW]
        if y[i, 0] and y[i, 0] % 2 == 0:  # a window that starts inside a span starts with its begin tag
            y[i, 0] -= 1
    return x, y


@functools.cache
def train(rounds: int = 500, batch: int = 96, rate: float = 0.02, seed: int = 3) -> Model:
    """Adam on labelled windows, with gradients clipped. The same arguments give the same model, which is trained once a process."""
    model = fresh()
    pool = examples(3000, seed)
    r = np.random.default_rng(seed)
    m, v = ([np.zeros_like(p) for p in model.parameters()] for _ in range(2))
    for step in range(1, rounds + 1):
        at = r.integers(0, len(pool[0]), batch)
        _, grads = gradients(model, pool[0][at], pool[1][at])
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads))
        now = rate * min(1.0, 3 * (1 - step / (rounds + 1)))
        for p, g, a, b in zip(model.parameters(), grads, m, v, strict=True):
            g = g / max(1.0, norm / 5)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def tag_spans(tags: list[int]) -> list[tuple[int, int, int]]:
    out, start, kind = [], -1, -1
    for i, t in enumerate([*tags, 0]):
        if start >= 0 and t != 2 * kind + 2:
            out.append((kind, start, i))
            start = -1
        if t % 2:
            start, kind = i, (t - 1) // 2
    return out


_ADDRESS = re.compile(
    r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:\s?@\s?|\s?[\[(]at[\])]\s?)[A-Za-z0-9-]+(?:\s?(?:\.|\[\.\]|[\[(]dot[\])])\s?[A-Za-z0-9-]+)*\s?(?:\.|\[\.\]|[\[(]dot[\])])\s?[A-Za-z]{2,}"
)


def plausible(kind: int, s: str) -> bool:
    """A model span's own test: what must hold for its kind however it is written."""
    n = len(only_digits(s))
    if kind == 0:
        return len(s) >= 6 and _ADDRESS.fullmatch(s) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= n <= 19 and luhn(only_digits(s))
    return 10 <= n <= 15 and len(re.findall(r"[0-9]+", s)) >= 3 and re.fullmatch(r"[+0-9().\s-]+", s) is not None


class Reader:
    """Reads texts with the model; windows of many texts go through it together."""

    def __init__(self, model: Model, batch: int = 2048) -> None:
        self.model, self.batch, self.network = model, batch, Network(model)
        moves = model.moves.astype(np.float64) - model.moves[0, 0]
        # what transitions add to a run of tags, next to staying outside: into each tag, at the text's start, and at most within and out of it
        self.into, self.start = moves[0, 1:].astype(np.float32), (model.start[1:] - model.start[0]).astype(np.float32)
        self.within, self.out = float(moves[1:, 1:].max()), float(moves[1:, 0].max())

    def emissions(self, coded: list[np.ndarray], wanted: list[tuple[int, tuple[int, int, int, int]]]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, first position, emissions) of the windows wanted, in no order; ``batch`` rows at most are read together.

        Each window's emissions are a copy, so that no rows read together outlive the next.
        """
        wanted = sorted(wanted, key=lambda w: w[1][0] - w[1][1])
        for k in range(0, len(wanted), self.batch):
            part = wanted[k : k + self.batch]
            length = np.array([b - a for _, (a, b, _, _) in part])
            x = np.zeros((length[0], len(part)), np.intp)
            for j, (i, (a, b, _, _)) in enumerate(part):
                x[: b - a, j] = coded[i][a:b]
            found = self.network.emissions(x, length)
            for j, (i, (a, _, first, last)) in enumerate(part):
                yield i, first, found[first - a : last - a, j].copy()
            del found

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """The spans of each text's best path."""
        coded = [symbols(t).astype(np.uint8) for t in texts]
        windows = [windows_of(len(c)) for c in coded]
        begin, go_on = ([np.empty(len(c), np.float32) for c in coded] for _ in range(2))
        for i, first, found in self.emissions(coded, [(i, w) for i, ws in enumerate(windows) for w in ws]):
            more = found[:, 1:] - found[:, :1]
            here = slice(first, first + len(found))
            go_on[i][here], begin[i][here] = more.max(1) + self.within, (more + self.into).max(1)
            if not first:
                begin[i][0] = (more[0] + self.start).max()
        runs: list[tuple[int, int, int]] = []
        again: dict[tuple[int, int], None] = {}
        for i, (s, g) in enumerate(zip(begin, go_on, strict=True)):
            if len(g):
                s[-1] += max(0.0, -self.out)  # a run that ends with the text has no way out to pay
                g[-1] += max(0.0, -self.out)
                at = np.flatnonzero(np.diff(np.concatenate(([False], possible(s, g, self.out), [False])).astype(np.int8)))
                for a, b in zip(at[::2].tolist(), at[1::2].tolist(), strict=True):
                    runs.append((i, a, b))
                    again |= dict.fromkeys((i, k) for k, w in enumerate(windows[i][max(0, a // STRIDE - 1) : b // STRIDE + 1], max(0, a // STRIDE - 1)) if w[2] < b and w[3] > a)
        if not runs:
            return [[] for _ in texts]
        rows = {(i, first): found for i, first, found in self.emissions(coded, [(i, windows[i][k]) for i, k in again])}
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        runs.sort(key=lambda r: r[2] - r[1])
        for part in batches_of(runs):
            steps = part[-1][2] - part[-1][1] + 1
            scores = np.full((steps, len(part), TAGS), -1e9, np.float32)
            scores[:, :, 0] = 0  # after its end a run is outside
            start = np.empty((len(part), TAGS), np.float32)
            for j, (i, a, b) in enumerate(part):
                start[j] = self.model.moves[0] if a else self.model.start
                for k in range(max(0, a // STRIDE - 1), min(len(windows[i]), b // STRIDE + 1)):
                    first, last = windows[i][k][2:]
                    if first < b and last > a:
                        scores[max(a, first) - a : min(b, last) - a, j] = rows[i, first][max(a, first) - first : min(b, last) - first]
                if b == len(coded[i]):  # nothing follows
                    scores[b - a - 1, j] -= self.model.moves[:, 0]
            tags = viterbi(self.model, scores, start)
            for j, (i, a, b) in enumerate(part):
                out[i] += [(kind, a + x, a + y) for kind, x, y in tag_spans(tags[j, : b - a].tolist())]
        return [sorted(spans, key=lambda s: s[1:]) for spans in out]

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """(base spans, all spans) of each text, by kind and start."""
        out = []
        for text, more in zip(texts, self.decode(texts), strict=True):
            base = base_spans(text)
            taken = sorted((a, b) for _, a, b in base)
            added = []
            for kind, a, b in more:
                while b > a and text[b - 1] in " \t\n.,":
                    b -= 1
                if plausible(kind, text[a:b]) and not any(x < b and a < y for x, y in taken) and clear(text, a, b):
                    added.append((kind, a, b))
                    taken.append((a, b))
            out.append((base, sorted(base + added)))
        return out


def batches_of(runs: list[tuple[int, int, int]], cells: int = 200_000) -> Iterator[list[tuple[int, int, int]]]:
    """Runs, which come by length, in lists that fill about so many steps."""
    first = 0
    for k in range(1, len(runs) + 1):
        if k == len(runs) or (k + 1 - first) * (runs[k][2] - runs[k][1] + 1) > cells:
            yield runs[first:k]
            first = k


def clear(text: str, a: int, b: int) -> bool:
    """The span stands alone: no letter or digit of the same run goes on beside it."""
    return not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind's name in brackets; of overlapping spans the first, then the longest."""
    out, last = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def _texts(batch: pa.RecordBatch, name: str, size: int = 2 << 20) -> Iterator[tuple[int, int, list[str]]]:
    for first, end, raw, at in chunks(string_column(batch, name), size):
        data = raw.tobytes()
        yield first, end, [data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256 and all spans of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for first, end, texts in _texts(batch, "text"):
                found = reader.spans(texts)
                counts = np.array([[sum(s[0] == k for s in base) for k in range(4)] for base, _ in found], np.int64).reshape(-1, 4)
                digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
                columns = [batch.column(0).slice(first, end - first), *(pa.array(counts[:, k]) for k in range(4)), pa.array(digest, pa.string()), pa.array([joined(every) for _, every in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted_batches(batches: Iterator[pa.RecordBatch], reader: Reader, text_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches with personal data in column ``text_at`` replaced, a megabyte of text at a time: a worker never holds a batch's texts twice."""
    for batch in batches:
        for first, end, texts in _texts(batch, "text", 1 << 20):
            part = batch.slice(first, end - first)
            new = [redacted(t, every) if every else t for t, (_, every) in zip(texts, reader.spans(texts), strict=True)]
            column = pa.array(new, pa.string(), mask=part.column(text_at).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([column if i == text_at else c for i, c in enumerate(part.columns)], names=names)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced by its kind; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    names = docs.schema.names
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from redacted_batches(batches, Reader(shared.value), text_at, names)

    return docs.select(*(quoted(c).alias("text" if c == "text" else f"c{i}") for i, c in enumerate(names))).mapInArrow(run, docs.schema)
