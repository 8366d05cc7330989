"""Quality rules: base counts of every text, and the frequency of its lines over the documents of its host.

Lines are normalised (ASCII letters lower-cased, runs of white space as one) and hashed (by ``xxhash64``-sized hashes that are no defence against made-up collisions), and each counts once for a document: rows of one key are
one document, whatever their texts, and a row without a key is one of its own. A line in
more than ``max(min_documents, max_share * documents of the host)`` documents of a host, or in more than ``max_documents`` of a host of
any size, is boilerplate: it is removed, and a document that loses more than ``max_loss`` of its words that way is rejected, as one that
fails the base rules is.

The share bounds the table of such lines for all but the largest hosts: a host has at most ``lines per document / max_share`` of them. Up to ``BROADCAST_LINES`` entries it is broadcast and no text is shuffled; beyond that it is joined by host and text.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows are
judged alike and each comes back; an empty table gives an empty result; further columns are passed through by
:func:`clean` and ignored by :func:`judge`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import small

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_DOCUMENTS = 10
MAX_SHARE = 0.1
MAX_DOCUMENTS = 1000
MAX_LOSS = 0.5
BROADCAST_LINES = 500_000
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, removed_lines bigint, removed_words bigint, kept boolean"


class Lines:
    """Lines with a word: their raw hashes, the hashes of their normal forms and how many words each has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: K.Words, raw: bool = True):
        breaks = np.flatnonzero(data == 10)
        start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
        start = start[start < len(data)]
        end = np.append(start[1:], len(data))
        # a line ends before its newline; texts end without one
        end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10)) if len(start) else end
        low, high = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
        some = high > low
        self.start, self.end, low, high = start[some], end[some], low[some], high[some]
        self.words = high - low
        self.text = words.text[low]
        if raw:
            self.exact = K.bytes_hashes(data, self.start, self.end)
        self.normal = K.run_hashes(K.bytes_hashes(K.LOWER[data], words.start, words.end), low, high)


def _hosts(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("host_key").to_numpy(zero_copy_only=False).view(np.uint64)


def _line_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches):
        data, offsets = K.raw(b.column("text"))
        lines = Lines(data, offsets, K.Words(data, offsets, K.SPACED), raw=False)
        new = K.firsts(lines.text, lines.normal)
        yield pa.RecordBatch.from_arrays(
            [b.column("host_key"), b.column("own_key"), K.listed(lines.normal[new], lines.text[new], b.num_rows)], ["host_key", "own_key", "lines"]
        )


def _listed(docs: DataFrame, host: str, own: Column) -> DataFrame:
    """host_key, own_key and the hashes of a text's different lines."""
    rows = docs.select(F.xxhash64(F.lit("host"), host).alias("host_key"), own.alias("own_key"), "text")
    return rows.mapInArrow(_line_lists, "host_key bigint, own_key bigint, lines array<bigint>")


def frequent_lines(docs: DataFrame, host: str, key: str, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """host_key, line: normal forms in too many of the host's documents."""
    # the null entry of each document counts the documents of the host
    each = lambda lists: lists.select("host_key", "own_key", F.explode(F.concat("lines", F.array(F.lit(None).cast("bigint")))).alias("line"))
    if docs.where(F.col(key).isNotNull()).groupBy(host, key).count().where("count > 1").limit(1).count():
        # keys come again: a line counts once for a key
        own = F.when(F.col(key).isNull(), F.xxhash64(F.lit("row"), F.monotonically_increasing_id())).otherwise(F.xxhash64(F.lit("key"), key))
        entries = each(_listed(docs, host, own)).distinct()
    else:
        entries = each(_listed(docs, host, F.lit(0).cast("bigint")))
    counts = entries.groupBy("host_key", "line").agg(F.count("*").alias("n"))
    limits = counts.where("line is null").select("host_key", F.least(F.greatest(F.lit(float(min_documents)), F.col("n") * max_share), F.lit(float(max_documents))).alias("most"))
    return counts.where(F.col("line").isNotNull() & (F.col("n") > min(min_documents, max_documents))).join(limits, "host_key").where("n > most").select("host_key", "line")


def _judge(batches: Iterator[pa.RecordBatch], banned: np.ndarray | None, cleaned: bool, max_loss: float) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches):
        data, offsets = K.raw(b.column("text"))
        n, words = b.num_rows, K.Words(data, offsets, K.SPACED)
        lines = Lines(data, offsets, words)
        hashes, first = K.grams(words.hashes(), words.text, 3)
        again = first[K.repeats(words.text[first], hashes)]
        repeated = np.zeros(len(words.start) + 2, bool)
        for k in range(3):
            repeated[again + k] = True
        inside = np.zeros(len(data), bool)
        inside[:] = K.SPACED[data] & K.LEAD[data]
        counts = {
            "n_words": words.counts,
            "word_chars": K.per_text(inside, offsets),
            "n_symbols": K.per_text(SYMBOLS[data], offsets),
            "n_dup_lines": np.bincount(lines.text, ~K.firsts(lines.text, lines.exact), n).astype(np.int64),
            "n_repeat_words": K.per_text(repeated[: len(words.start)], words.bounds),
        }
        failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * counts["n_words"])
        if banned is not None:
            gone = np.isin(K.mix(lines.normal ^ _hosts(b)[lines.text]), banned)
        else:
            own = b.column("banned")
            lists = own.fill_null([]) if own.null_count else own
            owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            gone = np.isin(K.within(lines.text, lines.normal), K.within(owner, lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)))
        removed = np.bincount(lines.text, gone * lines.words, n).astype(np.int64)
        kept = ~failed & (removed <= max_loss * counts["n_words"])
        out = {k: v.astype(np.int64) for k, v in counts.items()} | {"base_failed": failed, "removed_lines": np.bincount(lines.text, gone, n).astype(np.int64), "removed_words": removed, "kept": kept}
        columns = {c: b.column(c) for c in b.schema.names if c not in ("host_key", "text_key", "banned", *out)}
        if cleaned and gone.any():
            stay = np.ones(len(data), bool)
            for s, e in zip(lines.start[gone], lines.end[gone], strict=True):  # few: only lines that go
                stay[s : e + 1 if e < len(data) and data[e] == 10 else e] = False
            at = np.concatenate(([0], np.cumsum(K.per_text(stay, offsets))))
            text = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[stay]))])
            text = text.cast(pa.large_string()).cast(pa.string())
            columns["text"] = pa.array([None if was is None else now for was, now in zip(b.column("text").is_null().to_pylist(), text.to_pylist(), strict=True)]) if b.column("text").null_count else text
        elif not cleaned:
            columns.pop("text")
        yield pa.RecordBatch.from_pydict(columns | out)


def _run(docs: DataFrame, keep: list[str], cleaned: bool, host: str, key: str, min_documents: int, max_share: float, max_loss: float, broadcast_lines: int, max_documents: int) -> DataFrame:
    bad = frequent_lines(docs, host, key, min_documents, max_share, max_documents)
    rows = small(bad, broadcast_lines)
    carried = docs.select(*dict.fromkeys([*keep, "text"]), F.xxhash64(F.lit("host"), host).alias("host_key"), F.xxhash64("text").alias("text_key"))
    if rows is None:
        banned = None
        lists = _listed(docs, host, F.xxhash64("text")).withColumnRenamed("own_key", "text_key").dropDuplicates(["host_key", "text_key"])
        gone = lists.select("host_key", "text_key", F.explode("lines").alias("line")).join(bad, ["host_key", "line"]).groupBy("host_key", "text_key").agg(F.collect_set("line").alias("banned"))
        carried = carried.join(gone, ["host_key", "text_key"], "left")
    else:
        banned = np.sort(K.mix(np.array([r.line for r in rows], np.int64).view(np.uint64) ^ np.array([r.host_key for r in rows], np.int64).view(np.uint64)))
    order = [f"`{c}` {carried.schema[c].dataType.simpleString()}" for c in carried.columns if c not in ("host_key", "text_key", "banned") and (cleaned or c != "text")]
    return carried.mapInArrow(lambda batches: _judge(batches, banned, cleaned, max_loss), ", ".join([*order, VERDICT]))


def judge(docs: DataFrame, host: str = "source", key: str = "doc_id", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS, broadcast_lines: int = BROADCAST_LINES, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """One row per document: the key, the counts, ``base_failed``, what was removed, and ``kept``."""
    return _run(docs, [key], False, host, key, min_documents, max_share, max_loss, broadcast_lines, max_documents)


def clean(docs: DataFrame, host: str = "source", key: str = "doc_id", min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, max_loss: float = MAX_LOSS, broadcast_lines: int = BROADCAST_LINES, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """The documents that are kept, all their columns, texts without the removed lines."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, own, strict=True))
    names["text"] = "text"
    inner = docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in docs.columns])
    out = _run(inner, list(inner.columns), True, names[host], names[key], min_documents, max_share, max_loss, broadcast_lines, max_documents)
    return out.where("kept").select(*[F.col(names[c]).alias(c) for c in docs.columns])
