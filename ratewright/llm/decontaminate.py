"""Benchmark decontamination by winnowing.

Texts and items are cut into lower-case words of letters and digits. Of every ``WINDOW`` consecutive hashes of ``K_WORDS``
words the least is kept (the rightmost of equal ones): two texts that share ``K_WORDS + WINDOW - 1`` = 13 words share a kept
hash there. Kept hashes of documents are joined with those of the items (by shuffle together with the four words before or
after, of which a shared span has one or the other, so that a stock phrase of five words joins nothing by itself), a hit is extended along its diagonal, and words of
runs of at least 13 words are hit. An item of fewer words is one window: its hash over all its words is joined with the
hashes of as many words of each document.

Up to ``BROADCAST_ROWS`` fingerprints and ``BROADCAST_BYTES`` of text, the item side is broadcast: join and extension then happen in
the scan of the documents, and no text is shuffled. A larger benchmark is joined by shuffle on the fingerprint, and only the
texts of documents with a shared fingerprint meet the items they may hold.

Defined cases: a null text has no words; rows with the same key and text are judged alike and each comes back; items with
equal ids are one item with several texts; those with a null id hit like any other and count together as one item, but are left out of the list; an empty table gives an empty
result, and without items nothing is hit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut

SPAN = 13
K_WORDS = 5
WINDOW = SPAN - K_WORDS + 1
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
MIN_PERCENT = 5


def words_of(column: pa.Array) -> tuple[K.Words, np.ndarray]:
    data, offsets = K.raw(column)
    words = K.Words(K.LOWER[data], offsets, K.ALNUM)
    return words, words.hashes()


def winnow(hashes: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indexes of the entries that are the least of some ``window`` consecutive ones of their text."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    counts = np.bincount(text)
    first = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(len(hashes))
    whole = at + window <= first[text + 1]
    starts = at[whole]
    best = starts.copy()
    low = hashes[starts]
    for k in range(1, window):
        now = hashes[starts + k]
        take = now <= low
        best[take], low[take] = starts[take] + k, now[take]
    short = np.flatnonzero((counts > 0) & (counts < window))  # fewer than a window: all are kept
    rest = np.concatenate([np.arange(first[t], first[t + 1]) for t in short]) if len(short) else np.zeros(0, np.int64)
    return np.union1d(best, rest)


def _sided(words: K.Words, hashes: np.ndarray, marks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint with the ``(WINDOW - 1) / 2`` words before it, and with those after it, where its text has them: a span holds one or the other."""
    side = (WINDOW - 1) // 2
    grams, first = K.grams(hashes, words.text, side)
    known, value = np.zeros(len(hashes) + 1, bool), np.zeros(len(hashes) + 1, np.uint64)
    known[first], value[first] = True, grams
    before, after = np.maximum(at - side, -1), np.minimum(at + K_WORDS, len(hashes))  # the last entry is none
    has = lambda to: known[to] & (words.text[np.minimum(to, len(hashes) - 1)] == words.text[at])
    left, right = has(before), has(after)
    return np.concatenate((K.mix(marks[left] + K.mix(value[before[left]])), K.mix(~marks[right] + K.mix(value[after[right]])))), np.concatenate((at[left], at[right]))


def _marks(words: K.Words, hashes: np.ndarray, short: tuple[int, ...], items: bool, sided: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the index of the word at which each begins. short: the sizes of items of fewer than SPAN words."""
    five, at = K.grams(hashes, words.text, K_WORDS)
    kept = winnow(five, words.text[at])
    if items:  # only texts of a whole span
        kept = kept[words.counts[words.text[at[kept]]] >= SPAN]
    one, two = (five[kept], at[kept]) if not sided else _sided(words, hashes, five[kept], at[kept]) if len(kept) else (five[:0], at[:0])
    found, where = [one], [two]
    for n in short:
        g, at = K.grams(hashes, words.text, n)
        if items:
            own = words.counts[words.text[at]] == n
            g, at = g[own], at[own]
        found.append(K.mix(g + np.uint64(n)))
        where.append(at)
    return np.concatenate(found), np.concatenate(where)


def _fingerprints(batches: Iterator[pa.RecordBatch], short: tuple[int, ...], items: bool, sided: bool) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches):
        words, hashes = words_of(b.column("text"))
        marks, at = _marks(words, hashes, short, items, sided)
        order = np.argsort(words.text[at], kind="stable")
        marks, at = marks[order], at[order]
        text = words.text[at]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("text"), pa.array(words.counts.astype(np.int64)), K.listed(marks, text, b.num_rows), K.listed((at - words.bounds[text]).astype(np.int64), text, b.num_rows)],
            ["id", "text", "n_words", "marks", "at"],
        )


def fingerprints(df: DataFrame, key: str, short: tuple[int, ...], items: bool, sided: bool = False) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), F.col("text")).mapInArrow(lambda batches: _fingerprints(batches, short, items, sided), f"id {kind}, text string, n_words bigint, marks array<bigint>, at array<bigint>")


def _runs(doc: K.Words, a: np.ndarray, base: int, item: K.Words, c: np.ndarray, item_base: int, diagonal: int) -> Iterator[tuple[int, int]]:
    """Shared runs of a document's word hashes ``a`` and an item's ``c``; diagonal: a word's index in the document less that in the item."""
    least, s, e = min(SPAN, len(c)), max(0, diagonal), min(len(a), diagonal + len(c))
    if not least or e - s < least:
        return
    edge = np.flatnonzero(np.diff(np.concatenate(([0], a[s:e] == c[s - diagonal : e - diagonal], [0]))))
    for x, y in zip(edge[::2], edge[1::2], strict=True):
        if y - x >= least and _equal(doc, base + s + x, item, item_base + s - diagonal + x, y - x):
            yield s + x, s + y


def _equal(a: K.Words, i: int, b: K.Words, j: int, n: int) -> bool:
    """The exact check of a run whose word hashes are equal."""
    return all(a.data[a.start[i + k] : a.end[i + k]].tobytes() == b.data[b.start[j + k] : b.end[j + k]].tobytes() for k in range(n))


RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<string>"


class Index:
    """The items, their words' hashes and their fingerprints in order, built once on the driver (of a size that is checked) and broadcast."""

    def __init__(self, ids: list, texts: list[str], short: tuple[int, ...]):
        self.ids, self.short = ids, short
        self.item, self.hashes = words_of(pa.array(texts, pa.string()))
        marks, at = _marks(self.item, self.hashes, short, True)
        order = np.argsort(marks, kind="stable")
        self.marks, self.owner, self.at = marks[order], self.item.text[at[order]], (at - self.item.bounds[self.item.text[at]])[order]


def _scan(batches: Iterator[pa.RecordBatch], index, with_text: bool) -> Iterator[pa.RecordBatch]:
    x = index.value
    ids, item, ih, marks, owner, at, short = x.ids, x.item, x.hashes, x.marks, x.owner, x.at, x.short
    for b in K.slices(batches):
        doc, dh = words_of(b.column("text"))
        own, where = _marks(doc, dh, short, False)
        low, high = np.searchsorted(marks, own), np.searchsorted(marks, own, side="right")
        some = high > low
        times = (high - low)[some]
        entry = np.repeat(low[some], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        where = np.repeat(where[some], times)
        text = doc.text[where]
        hit, held = np.zeros(len(doc.start), bool), [set() for _ in range(b.num_rows)]
        for t, i, g in set(zip(text.tolist(), owner[entry].tolist(), (where - doc.bounds[text] - at[entry]).tolist(), strict=True)):
            d0, i0 = doc.bounds[t], item.bounds[i]
            for x, y in _runs(doc, dh[d0 : doc.bounds[t + 1]], d0, item, ih[i0 : item.bounds[i + 1]], i0, g):
                hit[d0 + x : d0 + y] = True
                held[t].add(ids[i])
        n_hit, n_words = K.per_text(hit, doc.bounds), doc.counts.astype(np.int64)
        lists = [sorted(str(x) for x in h if x is not None) for h in held]
        out = {
            "n_words": n_words, "n_hit": n_hit, "n_items": np.array([len(x) for x in held], np.int64), "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists],
            "contaminated": (n_hit > 0) & (100 * n_hit >= MIN_PERCENT * n_words), "item_ids": pa.array(lists, pa.list_(pa.string())),
        }
        yield pa.RecordBatch.from_pydict({c: b.column(c) for c in b.schema.names if with_text or c != "text"} | out)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shuffled way: rows of one document and one item that share fingerprints, to runs of shared words."""
    for b in K.slices(batches):
        (doc, dh), (item, ih) = words_of(b.column("text")), words_of(b.column("item_text"))
        low, high, row = [], [], []
        for r, diagonals in enumerate(b.column("diagonals").to_pylist()):
            d0, i0 = doc.bounds[r], item.bounds[r]
            for g in set(diagonals):
                for x, y in _runs(doc, dh[d0 : doc.bounds[r + 1]], d0, item, ih[i0 : item.bounds[r + 1]], i0, g):
                    low.append(x), high.append(y), row.append(r)
        row = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("row_key", "item_key")), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["row_key", "item_key", "low", "high"])


def _joined(docs: DataFrame, benchmark: DataFrame, item_key: str, short: tuple[int, ...]) -> DataFrame:
    """Texts are told apart by their SHA-256: what a text holds doesn't depend on its row."""
    scanned = fingerprints(docs, "text", short, False, True).withColumn("row_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = cut(scanned.groupBy("row_key").agg(F.first("text").alias("text"), F.first("n_words").alias("n_words"), F.first("marks").alias("marks"), F.first("at").alias("at")))
    items = cut(fingerprints(benchmark, item_key, short, True, True).where("n_words > 0").select(F.col("id").cast("string").alias("item_id"), F.sha2("text", 256).alias("item_key"), F.col("text").alias("item_text"), "marks", "at"))
    different = items.dropDuplicates(["item_key"])
    each = lambda df, *c: df.select(*c, F.explode(F.arrays_zip("marks", "at")).alias("m")).select(*c, F.col("m.marks").alias("mark"), F.col("m.at").alias("at"))
    item_marks = each(different, "item_key").withColumnRenamed("at", "item_at")
    pairs = each(texts, "row_key").join(item_marks, "mark").groupBy("row_key", "item_key").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"))
    met = pairs.join(different.select("item_key", "item_text"), "item_key").join(texts.select("row_key", "text"), "row_key")
    runs = cut(met.select("row_key", "text", "item_key", "item_text", "diagonals").mapInArrow(_extend, "row_key string, item_key string, low bigint, high bigint"))
    reach = F.aggregate(
        F.array_sort(F.collect_list(F.struct("low", "high"))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda s, r: F.struct((s.n + F.greatest(F.lit(0), r.high - F.greatest(s.to, r.low))).alias("n"), F.greatest(s.to, r.high).alias("to")),
        lambda s: s.n,
    )
    # a null id is an item too, but isn't listed
    held = runs.select("row_key", "item_key").distinct().join(items.select("item_key", "item_id").distinct(), "item_key").groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("item_id").isNull().cast("bigint")).alias("unnamed"))
    found = runs.groupBy("row_key").agg(reach.alias("n_hit")).join(held, "row_key")
    none = F.lit(0).cast("bigint")
    hit = texts.select("row_key", "n_words").join(found, "row_key", "left").withColumns({"n_hit": F.coalesce("n_hit", none), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    hit = hit.withColumns({"n_items": F.size("item_ids") + F.coalesce("unnamed", none), "items_sha256": F.sha2(F.array_join("item_ids", ","), 256), "contaminated": (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= MIN_PERCENT * F.col("n_words"))})
    return docs.withColumn("row_key", F.sha2(F.coalesce("text", F.lit("")), 256)).join(hit, "row_key", "left").drop("row_key")


def _run(docs: DataFrame, benchmark: DataFrame, item_key: str, with_text: bool, broadcast_rows: int, broadcast_bytes: int) -> DataFrame:
    """docs: columns of this module's naming, and the text."""
    items = fingerprints(benchmark, item_key, (), True).where("n_words > 0")
    total = items.agg(F.sum(F.size("marks") + F.when(F.col("n_words") < SPAN, 1).otherwise(0)).alias("marks"), F.sum(F.octet_length("text")).alias("bytes")).first()
    short = tuple(sorted(r.n_words for r in items.where(F.col("n_words") < SPAN).select("n_words").distinct().collect()))  # 12 rows at most
    if (total.marks or 0) > broadcast_rows or (total.bytes or 0) > broadcast_bytes:
        out = _joined(docs, benchmark, item_key, short)
        return out if with_text else out.drop("text")
    rows = items.select("id", "text").collect()
    index = docs.sparkSession.sparkContext.broadcast(Index([r.id for r in rows], [r.text for r in rows], short))
    schema = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns if with_text or c != "text"]
    return docs.mapInArrow(lambda batches: _scan(batches, index, with_text), ", ".join([*schema, RESULT]))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: the key, n_words, n_hit, n_items, items_sha256, contaminated, and item_ids, the sorted list itself."""
    out = _run(docs.select(F.col(key).alias("c0"), "text"), benchmark, item_key, False, broadcast_rows, broadcast_bytes)
    return out.select(F.col("c0").alias(key), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids")


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_key: str = "item_id", broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    names = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    out = _run(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), benchmark, item_key, True, broadcast_rows, broadcast_bytes)
    return out.where(~F.col("contaminated")).select(*[F.col(n).alias(c) for c, n in names.items()])
