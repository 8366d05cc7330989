"""Token ids of whole texts, as the tokenizers library gives them, at many times its speed.

Texts of a plain alphabet (ASCII, Latin letters with marks, general punctuation) are cut into pieces by the tokenizer's own
pre-tokenization rule, done here on whole arrays; each different piece is encoded by the library once per worker, and the
ids of a text are those of its pieces in turn. A text with any other character, or with a special token's string, goes to
the library whole. So ids are the library's in every case; tests compare both on all kinds of text.
"""

from __future__ import annotations

import json
import os
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import regex

from . import kernels as K

END = 0
#: Pieces that a worker remembers at most; then it starts anew.
REMEMBERED = 1_000_000
#: Texts given to the library at once.
AT_ONCE = 2048
#: Rules of the two kinds of file this module cuts itself (fixed by the tokenizers' format).
BYTE_LEVEL_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Pieces are told apart by hashes that differ from worker to worker, so that no text can be made to meet another.
_SEED = int.from_bytes(os.urandom(8), "little")
_LETTER, _NUMBER, _SPACE, _OTHER, _ODD = range(5)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kind(c: str) -> int:
    if regex.match(r"\p{L}", c):
        return _LETTER
    if regex.match(r"\p{N}", c):
        return _NUMBER
    return _SPACE if c in "\t\n\r " else _OTHER


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point below 0x180: the kind, and the lower case. By byte: whether it can begin a plain character."""
    kind, lower = np.full(0x180, _ODD, np.uint8), np.arange(0x180, dtype=np.int64)
    for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x180)]:
        if c != 0x130:
            kind[c] = _kind(chr(c))
            lower[c] = ord(chr(c).lower())
    kind[0xAD] = _ODD
    lead = np.zeros(256, bool)
    lead[:0x80] = lead[0xC2:0xC6] = lead[0xE2] = True
    return kind, lower, lead


def _classify(data: np.ndarray, lowered: bool) -> tuple[np.ndarray, np.ndarray]:
    """The kind of every byte's character (_ODD where it isn't plain), and the bytes, lower-cased if wanted."""
    kinds, lower, lead = _tables()
    out = kinds[np.minimum(data, 0x7F)]
    data = K.LOWER[data] if lowered else data
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        first, second = data[wide], data[wide + 1]
        kind = np.full(len(wide), _ODD, np.uint8)
        two = (first >= 0xC2) & (first <= 0xC5)
        code = ((first[two].astype(np.int64) & 0x1F) << 6) | (second[two] & 0x3F)
        kind[two] = kinds[code]
        if lowered:
            data = data.copy() if data.base is not None else data
            data[wide[two]], data[wide[two] + 1] = 0xC0 | lower[code] >> 6, 0x80 | lower[code] & 0x3F
        three = first == 0xE2
        third = data[np.minimum(wide + 2, len(data) - 1)]
        kind[three & (second == 0x80) & (third >= 0x90) & (third <= 0xA7)] = _OTHER
        out[wide] = out[wide + 1] = kind
        long = wide[first >= 0xE0]
        out[long + 2] = out[long]
        longest = wide[first >= 0xF0]
        out[longest + 3] = _ODD
    return out, data


def _cut(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, words_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, in order, by WORD_RULE or BYTE_LEVEL_RULE."""
    n = len(data)
    begins = np.zeros(n + 1, bool)  # of texts
    begins[offsets] = True
    start = begins.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    if words_only:
        start[:n] |= (kind == _NUMBER) & K.LEAD[data]
    # a run of one apostrophe before s, t, m, d, re, ve or ll takes those letters, unless a space before it is attached
    q = np.flatnonzero((data == 0x27) & start[:n])
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == _LETTER) & ~begins[q + 1]]
    if not words_only:
        q = q[begins[q] | (data[q - 1] != 0x20)]
    if len(q):
        a, b = data[q + 1], np.where(q + 2 < n, data[np.minimum(q + 2, n - 1)], 0)
        b = np.where(begins[np.minimum(q + 2, n)], 0, b)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        for some, size in ((one, 2), (two & ~one, 3)):
            start[q[some] + 1] = False
            start[q[some] + size] = True
    if words_only:
        at = np.flatnonzero(start)
        return at[:-1][kind[at[:-1]] != _SPACE], at[1:][kind[at[:-1]] != _SPACE]
    # the last white space before something else stands alone, or goes with what follows if it is a space
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~begins[1:n]) if n else np.zeros(0, np.int64)
    start[last] = True
    start[last[data[last] == 0x20] + 1] = False
    at = np.flatnonzero(start)
    return at[:-1], at[1:]


class Encoder:
    """Ids of texts by a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or ()]
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        split = (before.get("pretokenizers") or [{}])[0]
        self.words = split.get("pattern", {}).get("Regex") == WORD_RULE and [x["type"] for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.bytes = not normal and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of known pieces, sorted
        self.numbers = np.zeros(0, np.int32)  # which piece each is
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)  # where the ids of each piece begin; one more is the end
        self.size = 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(texts), AT_ONCE):
            found = [e.ids for e in self.library.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """hashes: sorted and unknown so far."""
        ids, counts = self._library(pieces)
        n, end = len(self.keys), self.size + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(end, len(self.ids) // 2), np.uint32)))
        if n + len(pieces) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros(max(len(pieces) + 1, n // 2), np.int64)))
        self.ids[self.size : end] = ids
        self.at[n + 1 : n + 1 + len(pieces)] = self.size + np.cumsum(counts)
        self.size = end
        place = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, place, hashes)
        self.numbers = np.insert(self.numbers, place, np.arange(n, n + len(pieces), dtype=np.int32))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, one text after the other, and how many each has (no end is added)."""
        n = len(offsets) - 1
        whole = np.ones(n, bool)
        kind = np.zeros(0, np.uint8)
        source = data
        if (self.words or self.bytes) and len(data):
            kind, data = _classify(data, self.words)
            whole = K.per_text(kind == _ODD, offsets) > 0
            joined = source.tobytes()
            if any(s in joined or s in data.tobytes() for s in self.special):
                for r in np.flatnonzero(~whole):
                    a, b = offsets[r], offsets[r + 1]
                    whole[r] = any(s in joined[a:b] or s in data[a:b].tobytes() for s in self.special)
        texts = [source[offsets[r] : offsets[r + 1]].tobytes().decode() for r in np.flatnonzero(whole)]
        other, other_counts = self._library(texts)
        counts = np.zeros(n, np.int64)
        counts[whole] = other_counts
        if whole.all():
            return other, counts
        if whole.any():
            stay = np.repeat(~whole, np.diff(offsets))
            data, kind = data[stay], kind[stay]
        plain_offsets = np.concatenate(([0], np.cumsum(np.diff(offsets)[~whole])))
        start, end = _cut(data, plain_offsets, kind, self.words)
        codes, found = pd.factorize(K.bytes_hashes(data, start, end, _SEED))
        if len(self.keys) > REMEMBERED:
            self.forget()
        order = np.argsort(found)
        ranked = found[order]
        place = np.searchsorted(self.keys, ranked)
        new = np.ones(len(ranked), bool)
        new[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] != ranked[place < len(self.keys)]
        if new.any():
            where = np.zeros(len(found), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            where = where[order[new]]
            joined = data.tobytes()
            self._learn(ranked[new], [joined[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            place = np.searchsorted(self.keys, ranked)
        number = np.empty(len(found), np.int64)
        number[order] = self.numbers[place]
        entry = number[codes]
        sizes = self.at[entry + 1] - self.at[entry]
        to = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.at[entry] - to + sizes, sizes) + np.arange(to[-1] if len(to) else 0)]
        ends = np.concatenate(([0], to))[np.searchsorted(start, plain_offsets)]
        counts[~whole] = np.diff(ends)
        if not whole.any():
            return ids, counts
        out = np.zeros(int(counts.sum()), np.uint32)
        place = np.repeat(whole, counts)
        out[place], out[~place] = other, ids
        return out, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_ends(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put END after the ids of each text."""
    out = np.full(len(ids) + len(counts), END, np.uint32)
    place = np.ones(len(out), bool)
    place[np.cumsum(counts + 1) - 1] = False
    out[place] = ids
    return out, counts + 1
