import random

import numpy as np
import pyarrow as pa
import pytest

from ratewright.llm import kernels as K
from ratewright.llm.tokens import Encoder, public_path, with_ends

PARTS = ["'s", "'S", "'re", "'l", "'ll", "'", "''", " '", "  's", "\n's", "\"'s", "a", "Zug", "ção", "Ünï", "ŸÆŁ", "ſ", "İ", "ı", "ǅ", "9", "007", "½²", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "!", "...", "—", "“q”", "…", " ", "­", " ", "日本", "é", "😀", "\x00", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "we'd've", "x'", "'tis", "_a_", "ΑΣ", "ß"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    rng = random.Random(7)
    texts = ["", *PARTS, *("".join(rng.choices(PARTS, k=rng.randint(1, 12))) for _ in range(4000)), *("".join(rng.choices(PARTS[:39], k=rng.randint(1, 30))) for _ in range(4000))]
    e = Encoder(public_path(name))
    at = 0
    for size in (1, 7, 500, len(texts)):
        some = texts[at : at + size]
        at += size
        ids, counts = e.encode(*K.raw(pa.array(some)))
        want, want_counts = e._library(some)
        ends = np.cumsum(counts)
        bad = [t for t, a, b, c in zip(some, ends - counts, ends, np.cumsum(want_counts), strict=True) if not np.array_equal(ids[a:b], want[c - (b - a) : c])]
        assert not bad[:5] and np.array_equal(counts, want_counts)
    assert with_ends(np.array([5, 6, 7], np.uint32), np.array([0, 2, 1]))[0].tolist() == [0, 5, 6, 0, 7, 0]


def thue_morse(n, a, b):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_regular_words_are_told_apart(name, n):
    """Words on which polynomial hashes modulo a power of two meet."""
    one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    assert one != two and len(one) == n
    data, offsets = K.raw(pa.array([one, two, f"{one} {two}"]))
    words = K.Words(data, offsets, K.SPACED)
    assert len(set(words.hashes().tolist())) == 2
    e = Encoder(public_path(name))
    ids, counts = e.encode(data, offsets)
    want, want_counts = e._library([one, two, f"{one} {two}"])
    assert np.array_equal(ids, want) and np.array_equal(counts, want_counts)


def test_hashes_depend_on_the_range_alone():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000, dtype=np.uint8)
    start = rng.integers(0, 4900, 3000)
    end = start + rng.integers(0, 20, 3000)
    hashes = K.bytes_hashes(data, start, end)
    of = {}
    for s, e, h in zip(start.tolist(), end.tolist(), hashes.tolist(), strict=True):
        assert of.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(of.values())) == len(of)
    runs = K.run_hashes(data.astype(np.uint64), start, end)
    of = {}
    for s, e, h in zip(start.tolist(), end.tolist(), runs.tolist(), strict=True):
        assert of.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(of.values())) == len(of) and set(runs[end > start].tolist()).isdisjoint(K.run_hashes(data.astype(np.uint64), start, end, 5).tolist())
