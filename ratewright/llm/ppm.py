"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of what followed them in the training documents. The
probability of a byte is found from the longest context seen: (2 n - 1) / (2 total) for one that followed it n times, or an escape,
kinds / (2 total) (method D), to the next shorter context, in which what the longer one had is excluded, down to the uniform order
-1. A document is its lower-cased (A-Z) words with one space between them, before them ``ORDER`` bytes 0xFF (which UTF-8 never has), and an end, 0xFF.

Nothing of the model is broadcast or gathered in one place, whatever its size:

1. Scans of the documents emit each task's different grams (contexts with what followed) and words with counts; Spark sums them up.
2. The trie is a table per order: a context, its counts by next byte (256 at most), and the totals that remain for its suffix after
   exclusion, found by joining each order with the next. A gram's log probability depends on the gram alone, so it is computed once for each
   different gram, by joining the grams not settled yet with one order after the other.
3. Documents are dealt into blocks of about ``BLOCK_BYTES``. Each block asks for its different grams and words, gets just those by a
   join, and scores its documents with them; both use one shuffle of the texts.

Beside the score there is a base: words (ended by ASCII white space) and one end per document, with add-one smoothing.

Defined cases: a null text is the empty text, whose score is that of its end; a null key is the empty string for the held-out rule;
repeated rows are documents of their own; without training rows every byte has probability 1/256 and N is 0; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import TASKS, stored, unstore

ORDER = 5
BLOCK_BYTES = 24 << 20
#: Blocks that get a partition of their own; among more of them, some share one.
NUMBERED = 1 << 16
#: Keys that a task holds before it merges equal ones, and merged ones before it hands them over.
HELD, HANDED = 1_000_000, 500_000
HELD_OUT = (7, 2)
PAD = 0xFF
#: Keys: a gram as a number of ORDER + 1 bytes; a word as its hash with the highest bit set; the end of a document.
END = np.int64(-1)
_HIGH = np.uint64(1 << 63)


def held_out(key: Column) -> Column:
    divisor, remainder = HELD_OUT
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % divisor == remainder


def spaced(words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text with one space between them, and the texts' offsets."""
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start] += 1
    edge[words.end] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    data = words.data.copy()
    later = words.start[1:][words.text[1:] == words.text[:-1]] - 1
    keep[later], data[later] = True, 0x20
    return data[keep], np.concatenate(([0], np.cumsum(K.per_text(keep, words.offsets))))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte and end, and where those of each text begin."""
    sizes = np.diff(offsets)
    n = len(sizes)
    base = offsets[:-1] + np.arange(n) * (ORDER + 1)
    padded = np.full(len(data) + n * (ORDER + 1), PAD, np.uint8)
    padded[np.arange(len(data)) + np.repeat((np.arange(n) + 1) * (ORDER + 1) - 1, sizes)] = data
    packed = np.zeros(max(0, len(padded) - ORDER), np.int64)
    for k in range(ORDER + 1):
        packed <<= 8
        packed |= padded[k : k + len(packed)]
    inside = np.ones(len(padded), bool)
    for k in range(ORDER):
        inside[base + sizes + 1 + k] = False
    return packed[inside[: len(packed)]], np.concatenate((offsets[:-1] + np.arange(n), [len(data) + n]))


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, K.Words]:
    words = K.Words(K.LOWER[data], offsets, K.SPACED)
    keys = (words.hashes() | _HIGH).view(np.int64)
    return np.where(keys == END, np.int64(-2), keys), words


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _tally(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different keys of a slice and how often the training rows among it have them."""
    data, offsets = K.raw(batch.column("text"))
    train = batch.column("train").to_numpy(zero_copy_only=False)
    keys, words = word_keys(data, offsets)
    found, at = grams(*spaced(words))
    for x, use in ((found, np.repeat(train, np.diff(at))), (keys, train[words.text])):
        codes, different = pd.factorize(x)
        yield different, np.bincount(codes, use, len(different)).astype(np.int64)
    yield np.array([END]), np.array([int(train.sum())])


def _merged(slices: Iterator[pa.RecordBatch], handed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tallies of slices, merged; those over ``handed`` keys are handed over at once."""
    parts, held = [], 0
    for b in slices:
        parts.extend(_tally(b))
        held += sum(len(x[0]) for x in parts[-3:])
        if held > HELD:
            parts = [_merge(parts)]
            if len(parts[0][0]) > handed:
                yield parts.pop()
            held = max(0, sum(len(x[0]) for x in parts) - HELD // 2)
    if parts:
        yield _merge(parts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, counts in _merged(K.slices(batches), HANDED):
        for k in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 50_000]), pa.array(counts[k : k + 50_000])], ["key", "n"])
    K.give_back()


def tally(rows: DataFrame) -> DataFrame:
    """``key`` and ``n`` of everything in the texts; n counts training rows only and may be 0."""
    return rows.select("text", "train").mapInArrow(_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def contexts(counts: DataFrame) -> list[DataFrame]:
    """By length of the context, from 0: context, kids (counts by next byte), total, kinds, left_total and left_kinds (of its suffix, after exclusion)."""
    orders = []
    grams_ = counts.where("key >= 0 and n > 0")
    for size in range(ORDER, -1, -1):
        if size < ORDER:
            grams_ = grams_.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (size + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        kids = F.map_from_entries(F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n")))
        table = grams_.groupBy(F.shiftright("key", 8).alias("context")).agg(kids.alias("kids"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
        orders.append(stored(table, f"contexts-{size}", None))
    orders.reverse()
    out = [orders[0].withColumns({"left_total": F.lit(0).cast("bigint"), "left_kinds": 256 - F.col("kinds")})]
    for size in range(1, ORDER + 1):
        shorter = orders[size - 1].select(F.col("context").alias("suffix"), F.col("kids").alias("more"), F.col("total").alias("all"), F.col("kinds").alias("all_kinds"))
        met = orders[size].withColumn("suffix", F.col("context").bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1))).join(shorter, "suffix")
        gone = F.aggregate(F.map_keys("kids"), F.lit(0).cast("bigint"), lambda s, byte: s + F.element_at("more", byte))
        out.append(met.select("context", "kids", "total", "kinds", (F.col("all") - gone).alias("left_total"), (F.col("all_kinds") - F.col("kinds")).alias("left_kinds")))
    return out


def log_probabilities(keys: DataFrame, orders: list[DataFrame]) -> DataFrame:
    """``key`` (grams, each once) and ``value``, the natural logarithm of the last byte's probability after the others.

    The orders of 0 and 1 byte have 257 rows at most in all and are broadcast, as all the grams that are left would meet at few keys.
    """
    settled = []
    rest = keys.select("key", F.lit(0.0).alias("value"), F.lit(None).cast("bigint").alias("total_"), F.lit(None).cast("bigint").alias("kinds_"), F.lit(False).alias("done"))
    for size in range(ORDER, -1, -1):
        byte = F.col("key").bitwiseAND(F.lit(255)).cast("int")
        met = rest.withColumn("context", F.shiftright(F.col("key").bitwiseAND(F.lit((1 << 8 * (size + 1)) - 1)), 8)).join(F.broadcast(orders[size]) if size < 2 else orders[size], "context", "left")
        n = F.try_element_at("kids", byte)
        total, kinds = F.coalesce("total_", "total"), F.coalesce("kinds_", "kinds")
        go = ~F.col("done") & F.col("total").isNotNull()
        step = F.when(n.isNotNull(), F.log((2 * n - 1) / (2 * total))).when(kinds > 0, F.log(kinds / (2 * total))).otherwise(0.0)
        met = met.select(
            "key",
            (F.col("value") + F.when(go, step).otherwise(0.0)).alias("value"),
            F.when(go & n.isNull(), F.col("left_total")).otherwise(F.col("total_")).alias("total_"),
            F.when(go & n.isNull(), F.col("left_kinds")).otherwise(F.col("kinds_")).alias("kinds_"),
            (F.col("done") | (go & n.isNotNull())).alias("done"),
        )
        if size == ORDER:  # nearly all grams are settled in the longest context; the others go on
            met = stored(met, "first-order", None)
            settled.append(met.where("done").select("key", "value"))
            rest = met.where("not done")
        else:
            rest = met
    last = rest.select("key", (F.col("value") + F.when(F.col("done"), 0.0).otherwise(-F.log(F.coalesce(F.col("kinds_"), F.lit(256)).cast("double")))).alias("value"))
    return reduce(DataFrame.union, [*settled, last])


def _asked(table: pa.Table) -> pa.Table:
    block = table.column("block")[0].as_py()
    [(keys, _)] = _merged(K.slices(iter(table.select(["text", "train"]).to_batches())), 1 << 62)
    K.give_back()
    return pa.table({"block": pa.array(np.full(len(keys), block), pa.int64()), "key": keys})


def _score(docs: pa.Table, values: pa.Table, end_count: int, n: int, v: int) -> pa.Table:
    keys, value = values.column("key").to_numpy(), values.column("value").to_numpy()
    order = np.argsort(keys)
    keys, value = keys[order], value[order]
    out = []
    for b in K.slices(iter(docs.to_batches())):
        data, offsets = K.raw(b.column("text"))
        words, w = word_keys(data, offsets)
        found, at = grams(*spaced(w))
        codes, different = pd.factorize(found)
        each = value[np.searchsorted(keys, different)][codes]
        score = np.add.reduceat(each, at[:-1]) if len(each) else np.zeros(b.num_rows)
        codes, different = pd.factorize(words)
        count = np.append(value[np.searchsorted(keys, different)][codes], 0.0)
        terms = np.log10((count[:-1] + 1) / (n + v + 1))
        sums = np.zeros(len(terms) + 1)
        np.cumsum(terms, out=sums[1:])
        base = sums[w.bounds[1:]] - sums[w.bounds[:-1]] + np.log10((end_count + 1) / (n + v + 1))
        known = K.per_text(count[:-1] > 0, w.bounds) + (end_count > 0)
        held = ~b.column("train").to_numpy(zero_copy_only=False)
        out.append(pa.RecordBatch.from_pydict({"id": b.column("id"), "held_out": held, "n_tokens": w.counts.astype(np.int64) + 1, "n_known": known, "train_tokens": np.full(b.num_rows, n), "base_score": base, "score": score / np.log(10), "n_bytes": np.diff(at) - 1}))
    K.give_back()
    return pa.Table.from_batches(out)


def numbers(spark: SparkSession, n: int) -> DataFrame:
    """For each of ``n`` slots a number that hashing by key into ``n`` partitions puts into the slot's own, so that no two blocks share a task. NUMBERED rows at most."""
    found = spark.range(20 * n).select(F.pmod(F.hash("id"), F.lit(n)).cast("bigint").alias("slot"), "id")
    return found.groupBy("slot").agg(F.min("id").alias("number"))


def score(docs: DataFrame, key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: the key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), n_bytes."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), "text", (~held_out(F.col(key))).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text") + 6)).first()[0] or 0
    blocks = -(-size // block_bytes) + 1
    counts = stored(tally(rows), "counts", None)
    words = counts.where("key < 0 and n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("key") == F.lit(int(END)), F.col("n"))).alias("end")).first()
    n, v, end = words.n or 0, words.v, words.end or 0
    orders = contexts(counts)
    of_words = counts.where("key < 0").select("key", F.col("n").cast("double").alias("value"))
    found = log_probabilities(counts.where("key >= 0").select("key"), orders).union(of_words)
    values = stored(found, "values", None)
    unstore(found)  # nothing else of the counts and contexts is needed
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("bigint"))
    dealt = dealt.join(F.broadcast(numbers(docs.sparkSession, min(blocks, NUMBERED))), "slot", "left").withColumn("block", F.coalesce("number", "slot")).select("block", "id", "text", "train")
    dealt = dealt.repartition(min(int(blocks), TASKS), "block")
    asked = dealt.groupBy("block").applyInArrow(_asked, "block bigint, key bigint")
    answered = asked.join(values, "key").select("block", "key", "value")
    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"
    out = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(lambda d, a: _score(d, a, end, n, v), schema)
    return out.withColumnRenamed("id", key)
