"""Substring dedup over sliding spans of sentences.

A sentence ends at a word that ends in ``.``, ``!`` or ``?`` (closing quotes and brackets may follow) or at a newline; one of
more than ``MAX_WORDS`` words is cut into pieces, which count as sentences, so that prose without stops is covered too: before words whose hash
is the least of those within ``NEAR`` words, and every ``MAX_WORDS`` from there, so that copies are cut alike at any offset.
Every run of ``SENTENCES`` consecutive ones is a span, whatever its words; they are hashed (96 bits) in lower case (ASCII). A caller who names
``min_words`` has runs lengthened until they have so many; one that its text's end keeps below that is no span then.
The hashes of all documents are grouped; the first occurrence, by key and place, stays, and a sentence inside any other
occurrence is removed.

Spans are counted first, summed up in the map tasks; a join that Spark can split where one span is very frequent keeps those that
occur again, and their first places are found among them. Texts are shuffled once, to meet what they lose.

Defined cases: a null text stays null; a text with fewer sentences than a span stays as it is; null keys come first
in order; rows with equal key and text are one document that occurs twice, and each comes back with the same result; an empty
table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, stored

SENTENCES = 3
MAX_WORDS = 12
MIN_WORDS = 0
NEAR = 4
#: Seed of the second hash of a span.
CHECK = 0x5851F42D4C957F2D

_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_CLOSE = np.isin(np.arange(256), np.frombuffer(b"\"')]}", np.uint8))


class Sentences:
    """The sentences of some texts, as ranges of their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, max_words: int = MAX_WORDS):
        self.words = w = K.Words(data, offsets, K.SPACED)
        n = len(w.start)
        if not n:
            self.low = self.high = self.text = np.zeros(0, np.int64)
            return
        last = w.end - 1
        stop = _STOP[data[last]]
        for k in (1, 2):  # one or two closing marks after the stop
            before = np.maximum(last - k, 0)
            closed = (last - k >= w.start) & _STOP[data[before]]
            for j in range(k):
                closed &= _CLOSE[data[last - j]]
            stop |= closed
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        first = np.ones(n, bool)
        first[1:] = stop[:-1] | (lines[w.start[1:]] > lines[w.end[:-1]]) | (w.text[1:] != w.text[:-1])
        begin = np.flatnonzero(first)
        first = first | self._content_cuts(data, begin, max_words)
        begin = np.flatnonzero(first)
        place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        self.low = np.flatnonzero(place % max_words == 0)
        self.high = np.append(self.low[1:], n)
        self.text = w.text[self.low]

    def _content_cuts(self, data: np.ndarray, begin: np.ndarray, max_words: int) -> np.ndarray:
        """Words of long sentences whose hash, with the next word's, is less than those of all within NEAR words of the sentence."""
        w, n = self.words, len(self.words.start)
        size = np.diff(np.append(begin, n))
        sentence = np.repeat(np.arange(len(begin)), size)
        value = K.bytes_hashes(K.LOWER[data], w.start, w.end)
        joint = value.copy()
        joint[:-1] += np.where(sentence[:-1] == sentence[1:], value[1:], np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15)
        joint = K.mix(joint)
        cut = (np.repeat(size, size) > max_words) & (np.arange(n) - begin[sentence] >= NEAR)
        for d in range(1, NEAR + 1):
            other = sentence[:-d] != sentence[d:]
            cut[d:] &= other | (joint[d:] < joint[:-d])
            cut[:-d] &= other | (joint[:-d] < joint[d:])
        return cut

    def bounds(self, texts: int) -> np.ndarray:
        """Where each text's sentences begin, and the end."""
        return np.searchsorted(self.text, np.arange(texts + 1))


def _spans(batches: Iterator[pa.RecordBatch], n: int, max_words: int, min_words: int) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches):
        data, offsets = K.raw(b.column("text"))
        s = Sentences(data, offsets, max_words)
        hashes = K.bytes_hashes(K.LOWER[data], s.words.start, s.words.end)
        at = np.flatnonzero(s.text[: max(0, len(s.text) - n + 1)] == s.text[n - 1 :]) if len(s.text) >= n else np.zeros(0, np.int64)
        last = at + n - 1
        if min_words and len(at):
            # the first sentence by which the run has enough words, if its text has one
            last = np.maximum(last, np.searchsorted(s.high, s.low[at] + min_words))
            some = last < len(s.low)
            some[some] = s.text[last[some]] == s.text[at[some]]
            at, last = at[some], last[some]
        low, high = s.low[at], s.high[last]
        span, check = K.run_hashes(hashes, low, high), K.run_hashes(hashes, low, high, CHECK)
        base = s.bounds(b.num_rows)
        entries = pa.StructArray.from_arrays([pa.array(span.view(np.int64)), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array((at - base[s.text[at]]).astype(np.int32)), pa.array((last - at + 1).astype(np.int32))], ["span", "check", "at", "many"])
        counts = np.concatenate(([0], np.cumsum(np.bincount(s.text[at], minlength=b.num_rows)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("text_key"), pa.ListArray.from_arrays(pa.array(counts), entries)], ["key", "text_key", "spans"])


def _remove(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches):
        data, offsets = K.raw(b.column("text"))
        s = Sentences(data, offsets, max_words)
        base = s.bounds(b.num_rows)
        lists = b.column("later")
        lists = lists.fill_null([]) if lists.null_count else lists
        counts = np.diff(lists.offsets.to_numpy())
        runs = lists.flatten()
        at = np.repeat(base[:-1], counts) + runs.field("at").to_numpy(zero_copy_only=False)
        open_ = np.zeros(len(s.low) + 1, np.int64)
        np.add.at(open_, at, 1)
        np.add.at(open_, at + runs.field("many").to_numpy(zero_copy_only=False), -1)
        gone = np.cumsum(open_)[:-1] > 0
        stay = np.ones(len(data) + 1, np.int8)
        if gone.any():
            # from the first word of a removed sentence to the next word, or to the end of the text
            starts = s.words.start[s.low[gone]]
            follows = np.append(s.words.start, len(data))[s.high[gone]]
            ends = np.minimum(follows, offsets[1:][s.text[gone]])
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, ends, -1)
            stay = (np.cumsum(edge) == 0).astype(np.int8)
        keep = stay[: len(data)].astype(bool)
        to = np.concatenate(([0], np.cumsum(K.per_text(keep, offsets)))).astype(np.int64)
        text = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(data[keep]))]).cast(pa.large_string()).cast(pa.string())
        if b.column("text").null_count:
            text = pa.array([None if was else now for was, now in zip(b.column("text").is_null().to_pylist(), text.to_pylist(), strict=True)], pa.string())
        removed = np.bincount(s.text, gone, b.num_rows).astype(np.int64)
        words = np.bincount(s.text, gone * (s.high - s.low), b.num_rows).astype(np.int64)
        out = {c: b.column(c) for c in b.schema.names if c != "later"} | {"text": text}
        yield pa.RecordBatch.from_pydict(out | {"n_sentences": np.diff(base).astype(np.int64), "n_removed": removed, "removed_words": words})


def later_spans(docs: DataFrame, key: str, sentences: int = SENTENCES, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """key, text_key and ``later``: where spans begin, in sentences, that are not the first of their kind, and how many each has."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64("text").alias("text_key"), F.col("text"))
    entries = rows.mapInArrow(lambda batches: _spans(batches, sentences, max_words, min_words), f"key {kind}, text_key bigint, spans array<struct<span:bigint,check:int,at:int,many:int>>")
    entries = entries.select("key", "text_key", F.inline("spans"))
    where = F.struct("key", "text_key", "at")
    # only the hashes and their counts are shuffled for all spans; keys and places follow for those that occur again
    again = entries.groupBy("span", "check").agg(F.count("*").alias("n")).where("n > 1").select("span", "check")
    met = stored(entries.join(again, ["span", "check"]), "repeated-spans")
    firsts = cut(met.groupBy("span", "check").agg(F.min(where).alias("first")))  # on its own, so that Spark can split the join on a very frequent span
    later = met.join(firsts, ["span", "check"]).where(where != F.col("first"))
    return later.groupBy("key", "text_key").agg(F.collect_set(F.struct("at", "many")).alias("later"))


def dedup(docs: DataFrame, key: str = "doc_id", sentences: int = SENTENCES, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """All documents and columns, texts without what is repeated, then ``span_report``: a struct of n_sentences, n_removed, removed_words."""
    names = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    later = later_spans(rows, names[key], sentences, max_words, min_words)
    met = rows.withColumn("text_key", F.xxhash64("text")).alias("d").join(later.alias("l"), (F.col("d.text_key") == F.col("l.text_key")) & F.col(f"d.{names[key]}").eqNullSafe(F.col("l.key")), "left")
    met = met.select(*[F.col(f"d.{n}") for n in names.values()], "l.later")
    schema = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names.values()]
    out = met.mapInArrow(lambda batches: _remove(batches, max_words), ", ".join([*schema, "n_sentences bigint, n_removed bigint, removed_words bigint"]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], F.struct("n_sentences", "n_removed", "removed_words").alias("span_report"))
