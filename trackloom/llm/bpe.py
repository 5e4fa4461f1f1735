"""Byte-level BPE encoding and decoding.

Texts become code points, code points become symbols (a class, with what the next characters allow), and each symbol is a transition
function of a small automaton whose state says which kind of piece is open. The functions are composed by table in an associative block
scan, which gives the state at every character and so the piece boundaries, without a regular expression. Pieces are hashed, and only
pieces that are new to a worker go through pair merging; the rest comes from its cache, and the ids' bytes are checked against the text's,
so a shared hash costs time but changes nothing. Token ids keep their byte lengths, so decoding
is a gather from the vocabulary's bytes.

Null texts count as empty: no tokens, and the hash of no bytes. Texts of any length are encoded whole; ties and repeated rows do not
matter, as each row stands alone. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import CHUNK, chunks, slice_hashes, string_column

LETTER, NUMBER, OTHER, BLANK = range(4)
#: The code points with the property White_Space.
WHITE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)

# Symbols: a character's class with what follows it in the text.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_INNER, S_SPACE, S_LAST = range(8)
# S_SHORT, S_LONG: an apostrophe before one of s t m d, or re ve ll. S_INNER: white space before white space or the end.
# S_SPACE: a space before other text. S_LAST: other white space before other text.
N_SYMBOLS = 8
# States: the piece that is open.
Q_LETTER, Q_NUMBER, Q_OTHER, Q_BLANK, Q_SPACE, Q_ONE, Q_TWO, Q_DONE = range(8)
# Q_SPACE: a space that the next run may join. Q_ONE, Q_TWO: a contraction that lacks one or two letters. Q_DONE: none.


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after ``symbol``, and whether a piece starts at it."""
    if symbol == S_LETTER:
        if state == Q_TWO:
            return Q_ONE, False
        if state == Q_ONE:
            return Q_DONE, False
        return Q_LETTER, state not in (Q_LETTER, Q_SPACE)
    if symbol == S_NUMBER:
        return Q_NUMBER, state not in (Q_NUMBER, Q_SPACE)
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in (Q_OTHER, Q_SPACE):
            return Q_OTHER, False
        return {S_OTHER: Q_OTHER, S_SHORT: Q_ONE, S_LONG: Q_TWO}[symbol], True
    if symbol == S_INNER:
        return Q_BLANK, state != Q_BLANK
    return (Q_SPACE if symbol == S_SPACE else Q_DONE), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, then of each symbol at a text's start; composition table; state after a function from Q_DONE; starts by state and symbol)."""
    plain = [tuple(_step(q, s)[0] for q in range(8)) for s in range(N_SYMBOLS)]
    first = [(f[Q_DONE],) * 8 for f in plain]
    functions = list(dict.fromkeys([tuple(range(8)), *plain, *first]))
    known = {f: i for i, f in enumerate(functions)}
    i = 0
    while i < len(functions):
        for g in plain + first:
            for a, b in ((functions[i], g), (g, functions[i])):
                if (h := tuple(b[x] for x in a)) not in known:
                    known[h] = len(functions)
                    functions.append(h)
        i += 1
    table = np.array([[known[tuple(b[x] for x in a)] for b in functions] for a in functions])
    starts = np.array([[_step(q, s)[1] for s in range(N_SYMBOLS)] for q in range(8)])
    return np.array([known[f] for f in plain + first]), table, np.array([f[Q_DONE] for f in functions], np.uint8), starts


SYMBOL_FUNCTION, COMPOSE, AFTER, STARTS = _monoid()
_COUNT = len(COMPOSE)
_FLAT = COMPOSE.astype(np.uint16).ravel()
_classes: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK of every code point, as the tokenizer library's own Unicode tables have them.

    Its version of Unicode may be newer than Python's, so the library is asked, once a process, about the code points of the planes for
    text that Python has as unassigned: in a vocabulary whose only merges join a letter, or a digit, with the byte after it, such a merge
    shows that the code point belongs to the same run. Of other planes no code point is a letter or number.
    """
    if not _classes:
        import tiktoken

        found = np.full(0x110000, OTHER, np.uint8)
        group = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x40000)], np.uint8)
        found[: len(group)] = group
        points = np.array([c for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn"])
        for probe, kind in (("a", LETTER), ("1", NUMBER)):
            single = ord(probe)
            ranks = {bytes([i]): i for i in range(256)} | {bytes([single, i]): 256 + i for i in range(256)}
            library = tiktoken.Encoding(f"classes of {probe}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            for k in range(0, len(points), 4096):
                ids = np.array(library.encode_ordinary("".join(probe + chr(c) for c in points[k : k + 4096].tolist())))
                joins = ids[(ids >= 256) | (ids == single)] >= 256
                found[points[k : k + 4096][joins]] = kind
        found[list(WHITE)] = BLANK
        _classes.append(found)
    return _classes[0]


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of an array of function numbers, by blocks: within all blocks at once, then over the blocks."""
    n = len(functions)
    if n <= 64:
        out, acc = np.empty(n, np.uint16), 0
        for i, f in enumerate(functions.tolist()):
            acc = int(f) if i == 0 else int(_FLAT[acc * _COUNT + f])
            out[i] = acc
        return out
    width = int(min(256, max(8, np.sqrt(n))))
    rows = -(-n // width)
    identity = 0
    padded = np.full(rows * width, identity, np.uint16)
    padded[:n] = functions
    by_step = np.ascontiguousarray(padded.reshape(rows, width).T)
    for k in range(1, width):
        by_step[k] = _FLAT[by_step[k - 1].astype(np.intp) * _COUNT + by_step[k]]
    whole = scan(by_step[-1].copy())
    before = np.concatenate((np.array([identity], np.uint16), whole[:-1]))
    return _FLAT[before[:, None].astype(np.intp) * _COUNT + by_step.T].ravel()[:n]


def piece_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets at which pieces start, over the texts whose bytes lie between the offsets ``at``."""
    if not len(raw):
        return np.zeros(0, np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    n = len(points)
    kind = code_point_classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(lead, at)] = True
    blank = kind == BLANK
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_INNER], np.uint8)[kind]
    next_blank = np.concatenate((blank[1:], [True])) | edge[1:]
    last = blank & ~next_blank
    symbol[last] = S_LAST
    symbol[last & (points == 32)] = S_SPACE
    marks = np.flatnonzero(points == 39)
    if len(marks):
        wide = np.concatenate((points, np.zeros(2, np.uint32)))
        far = np.concatenate((edge, [True, True]))
        one = ~far[marks + 1]
        two = one & ~far[marks + 2]
        a, b = wide[marks + 1], wide[marks + 2]
        short = one & np.isin(a, [ord(x) for x in "stmd"])
        long = two & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
        symbol[marks[short]] = S_SHORT
        symbol[marks[long]] = S_LONG
    function = SYMBOL_FUNCTION[symbol + edge[:-1] * np.uint8(N_SYMBOLS)]
    state = AFTER[scan(function)]
    before = np.concatenate(([Q_DONE], state[:-1]))
    return lead[STARTS[before, symbol] | edge[:-1]]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: whole if the vocabulary has it, else by merging the pair of least rank, leftmost first."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 48:
        parts = [piece[i : i + 1] for i in range(n)]
        costs = [ranks.get(parts[i] + parts[i + 1]) for i in range(n - 1)]
        while True:
            best, at = None, -1
            for i, r in enumerate(costs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1])
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes chunks of texts; pieces seen before come from a cache of bounded size."""

    def __init__(self, ranks: dict[bytes, int], cache: int = 450_000) -> None:
        self.ranks, self.limit = ranks, cache
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for piece, i in ranks.items():
            by_id[i] = piece
        self.vocab = np.frombuffer(b"".join(by_id), np.uint8)
        self.length = np.array([len(x) for x in by_id], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.forget()

    def forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def add(self, key: int, ids: list[int]) -> int:
        slot = len(self.slots)
        if slot == len(self.first):
            self.first, self.count = np.concatenate((self.first, self.first)), np.concatenate((self.count, self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, self.ids))
        self.slots[key], self.first[slot], self.count[slot] = slot, self.used, len(ids)
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return slot

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids).

        The ids' bytes are compared with the text's. Where they differ, two pieces share a hash, and the chunk is encoded without cache.
        """
        starts = piece_starts(raw, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        ends = np.concatenate((starts[1:], [len(raw)]))
        keys, where, back = np.unique(slice_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.slots) > self.limit or self.used > 16 * self.limit:
            self.forget()
        get, data = self.slots.get, raw.tobytes()
        slots = [get(k, -1) for k in keys.tolist()]
        s, e = starts[where], ends[where]
        for i in [i for i, x in enumerate(slots) if x < 0]:
            slots[i] = self.add(int(keys[i]), merge(data[s[i] : e[i]], self.ranks))
        slot = np.array(slots, np.int64)[back]
        ids, per = gather(self.ids, self.first[slot], self.count[slot])
        decoded = self.decode(ids)[0]
        if len(decoded) != len(raw) or not np.array_equal(decoded, raw):
            self.forget()
            exact = [merge(data[a:b], self.ranks) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            ids, per = np.array([i for x in exact for i in x], np.uint32), np.array([len(x) for x in exact])
        upto = np.concatenate(([0], np.cumsum(per)))
        return ids, upto[np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids one after another, byte length of each id)."""
        return gather(self.vocab, self.offset[ids], self.length[ids])


def gather(source: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """source[f : f + c] for each f, c, end to end; and the counts."""
    total = int(count.sum())
    if not total:
        return source[:0], count
    base = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return source[base + np.arange(total)], count


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_texts(ranks: dict[bytes, int], texts: list[str]) -> list[list[int]]:
    """Ids of a few texts on the driver, as the distributed path computes them."""
    out: list[list[int]] = []
    encoder = Encoder(ranks)
    for _, _, raw, at in chunks(pa.array(texts, pa.large_string())):
        ids, upto = encoder.encode(raw, at)
        out += [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)]
    return out


def bpe_digest(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; ``with_ids`` adds the ids and each id's byte length.

    The rank file is read on the driver and broadcast: its size is that of the vocabulary, whatever the corpus.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, byte_lengths array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            for first, end, raw, at in chunks(string_column(batch, "text"), CHUNK // 2 if with_ids else CHUNK):
                ids, upto = encoder.encode(raw, at)
                back, lengths = encoder.decode(ids)
                ends = np.concatenate(([0], np.cumsum(lengths)))[upto]
                as_bytes, decoded = np.ascontiguousarray(ids, "<u4").tobytes(), back.tobytes()
                columns = [
                    keys.slice(first, end - first),
                    pa.array(np.diff(upto)),
                    pa.array([hashlib.sha256(as_bytes[4 * a : 4 * b]).hexdigest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.string()),
                    pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, lengths)]
                    names += ["ids", "byte_lengths"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
