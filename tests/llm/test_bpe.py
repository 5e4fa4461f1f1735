import hashlib
import struct

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import bpe

from data import documents

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = st.sampled_from(["'s", "'ll", "'re", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "Z", "é", "漢", "١", "²", "!", "😀", "́", "tle", "12"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=1, max_size=6))
def test_like_the_library(texts):
    assert bpe.encode_texts(RANKS, texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_long_pieces_and_a_full_cache():
    encoder = bpe.Encoder(RANKS, cache=3)
    from trackloom.llm._common import chunks
    import pyarrow as pa

    for t in ("abc" * 5000, "-" * 999, "one two three four five", " " * 700 + "x"):
        for _, _, raw, at in chunks(pa.array([t], pa.large_string())):
            assert encoder.encode(raw, at)[0].tolist() == LIBRARY.encode_ordinary(t)


def test_scan_composes_in_order():
    import numpy as np

    f = np.random.default_rng(0).integers(0, len(bpe.COMPOSE), 5000)
    acc, want = None, []
    for x in f.tolist():
        acc = x if acc is None else int(bpe.COMPOSE[acc, x])
        want.append(acc)
    assert bpe.scan(f).tolist() == want


def test_digests(spark):
    docs = documents(spark)
    got = sorted(map(tuple, bpe.bpe_digest(docs, PATH).collect()), key=repr)
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.bpe_digest(documents(spark, []), PATH).count() == 0
    row = bpe.bpe_digest(docs.where("doc_id = 9"), PATH, with_ids=True).first()
    assert sum(row.byte_lengths) == len("été \U0001f600 naïve 漢字 don't 12'll".encode()) and len(row.ids) == row.n_tokens


def test_twin_pieces_and_shared_hashes(spark, monkeypatch):
    from test_chosen_path import thue_morse

    texts = [" ".join(thue_morse(k, s) for s in (0, 1)) for k in (10, 11, 12)]
    want = [LIBRARY.encode_ordinary(t) for t in texts]
    assert bpe.encode_texts(RANKS, texts) == want
    docs = documents(spark, [(i, t, "en", "s", 0, 0.5, 1) for i, t in enumerate(texts)])
    assert sorted((r.doc_id, r.n_tokens) for r in bpe.bpe_digest(docs, PATH).collect()) == [(i, len(w)) for i, w in enumerate(want)]
    monkeypatch.setattr(bpe, "slice_hashes", lambda raw, s, e: (e - s).astype("uint64"))  # pieces of the same length share a hash
    assert bpe.encode_texts(RANKS, [*texts, "one two six ten"]) == [*want, LIBRARY.encode_ordinary("one two six ten")]


def test_class_of_every_code_point():
    """A vocabulary whose only merges are a letter, digit or sign with the next byte shows which class the library gives a code point."""
    import numpy as np

    ranks = {bytes([i]): i for i in range(256)}
    for probe in b"a1!":
        ranks |= {bytes([probe, i]): len(ranks) + i for i in range(256)}
    library = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.code_point_classes()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for probe, kind in (("a", bpe.LETTER), ("1", bpe.NUMBER), ("!", bpe.OTHER)):
        got = np.array([t[0] >= 256 for t in map(library.encode_ordinary, (probe + chr(c) for c in points))])
        wrong = np.flatnonzero(got != (mine[points] == kind))
        assert not len(wrong), (kind, [hex(points[i]) for i in wrong[:20]], len(wrong))
