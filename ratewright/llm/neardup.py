"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five lower-case words (a shorter text is one shingle). A shingle weighs its count in the text times its inverse document
frequency, ``1 + log((1 + N) / (1 + df))``. Two texts are linked if their weighted Jaccard similarity, the sum of the lesser weights
over that of the greater ones, is 0.8 or more: what both have must outweigh what one has, and rare shingles (those of edits too) count
for more than common ones. Document frequencies come from a sketch of ``SLOTS`` counters over all documents, built in the map tasks and
added up in a tree: it has a fixed size, and its error is a fixed share of N at any N.

1. Every text gets ``BANDS`` x ``ROWS`` consistent weighted samples (Ioffe's improved scheme: the least of
   ``c / (y e^r)`` with ``y = e^(r (t - beta))`` and ``t = floor(log w / r + beta)``, all drawn from the shingle's hash), one key per
   band, and its weights added up in ``PLACES`` places. As sums hide differences and never make any, the weighted similarity of two
   texts' places is at least their own: a pair that the places put below 0.8 has no link. Equal texts are one from here on.
2. Texts with a band in common are candidates. First, buckets are dealt out in blocks of about ``NEAR`` texts, which all have the bucket's first
   text, and every text is paired with the likeliest one before it in its block.
3. Pairs are verified on their whole texts by the weighted similarity.
4. Classes are connected components. Then buckets are gone through again with the classes known, and every pair between two
   classes that the places allow is verified, so that no link that joins classes is lost to the choice of step 2. Buckets of more than ``RUN``
   texts are dealt out in blocks, and every block meets every other of its bucket in some task; only blocks within the bucket's
   largest class need not.

A pair of similarity 0.8 shares no band with probability ``(1 - 0.8**3)**10`` < 0.1 %; nothing else is left to chance.

Defined cases: null and empty texts have no shingles and are copies of each other; repeated rows are copies; ties go to the
smallest key, nulls last; an empty table gives an empty result; other columns are kept by :func:`dedup`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, stored
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
SLOTS = 1 << 20
BLOCKS = 64
FAN_IN = 64
#: Places of a text's sums, and the steps between their codes, one byte each: relative, from a weight of 1 on.
PLACES, CODE_STEP = 512, 0.045
#: Texts of a bucket that meet in one task: in step 2, and in step 4.
NEAR, RUN = 64, 500

_rng = np.random.default_rng(20240229)
_ODDS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_Q = (np.arange(1 << 16) + 0.5) / (1 << 16)


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1), by inverting 1 - (1 + x) e^-x."""
    x = np.linspace(0, 25, 1 << 20)
    return np.interp(_Q, 1 - (1 + x) * np.exp(-x), x)


_R = _gamma_quantiles()
_R_INVERSE = 1 / _R
_LOG_C = np.log(_R)


class Shingles:
    """Distinct shingles of each text and how often it has them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        words = K.Words(K.LOWER[data], offsets, K.SPACED)
        hashes = words.hashes()
        grams, at = K.grams(hashes, words.text, SHINGLE)
        text = words.text[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
        if len(short):
            grams = np.concatenate((grams, K.run_hashes(hashes, words.bounds[short], words.bounds[short + 1])))
            text = np.concatenate((text, short))
        codes, found = pd.factorize(K.within(text, grams))
        where = np.zeros(len(found), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        order = np.argsort(text[where], kind="stable")
        self.text, self.hash = text[where][order], grams[where][order]
        self.count = np.bincount(codes, minlength=len(found))[order]
        self.bounds = np.searchsorted(self.text, np.arange(n + 1))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, n = np.zeros(SLOTS, np.int64), 0
    for b in K.slices(batches):
        s = Shingles(*K.raw(b.column("text")))
        counts += np.bincount((s.hash & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        n += b.num_rows
    part = TaskContext.get().partitionId()
    blocks = counts.reshape(BLOCKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS + 1)), pa.array(np.full(BLOCKS + 1, part)), pa.array([*(x.tobytes() for x in blocks), np.array([n]).tobytes()], pa.binary())], ["block", "part", "counts"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
    return pd.DataFrame({"block": pdf["block"][:1], "part": pdf["parent"][:1], "counts": [total.tobytes()]})


def weights(docs: DataFrame) -> np.ndarray:
    """The inverse document frequency by slot; SLOTS numbers at any size of input."""
    parts = cut(docs.select("text").mapInArrow(_frequencies, "block bigint, part bigint, counts binary"))
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        n = -(-n // FAN_IN)
        parts = parts.withColumn("parent", F.floor(F.col("part") / FAN_IN)).groupBy("block", "parent").applyInPandas(_add, "block bigint, part bigint, counts binary")
        if n <= 1:
            break
    rows = sorted((r.block, r.counts) for r in parts.collect())  # BLOCKS + 1 rows
    if not rows:
        return np.ones(SLOTS, np.float32)
    total = int(np.frombuffer(rows[-1][1], np.int64)[0])
    df = np.concatenate([np.frombuffer(c, np.int64) for _, c in rows[:-1]])
    return (1 + np.log((1 + total) / (1 + np.minimum(df, total)))).astype(np.float32)


def _bands(s: Shingles, weight: np.ndarray, n: int) -> np.ndarray:
    """A key for each text and band; texts without shingles have keys of their own that nobody else uses."""
    keys = np.zeros((n, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(s.bounds))
    starts = s.bounds[:-1][full]
    log_w = np.log(weight)
    for band in range(BANDS):
        key = np.full(len(full), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            drawn = s.hash * _ODDS[k]
            i = (drawn >> np.uint64(48)).astype(np.intp)
            c = ((drawn >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)
            beta = ((drawn >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float64) * (1 / 65536)
            t = np.floor(log_w * _R_INVERSE[i] + beta)
            low = np.minimum.reduceat(_LOG_C[c] - _R[i] * (t - beta + 1), starts) if len(full) else np.zeros(0)
            # the least value depends on the shingle and t alone, so it stands for both
            key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + low.view(np.uint64))
        keys[full, band] = key
    return keys


def _places(s: Shingles, weight: np.ndarray, n: int) -> list[bytes]:
    """The codes of each text's weights, added up by place; 0 where there is none."""
    at = s.text * PLACES + (s.hash >> np.uint64(20) & np.uint64(PLACES - 1)).astype(np.int64)
    sums = np.bincount(at, weight, n * PLACES)
    codes = np.zeros(n * PLACES, np.uint8)
    some = sums > 0
    codes[some] = np.clip(np.round(np.log(sums[some]) / CODE_STEP) + 1, 1, 255)
    return [x.tobytes() for x in codes.reshape(n, PLACES)]


_SUMS = np.concatenate(([0], np.exp(CODE_STEP * np.arange(255)))).astype(np.float32)


def _signatures(batches: Iterator[pa.RecordBatch], idf) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches):
        s, n = Shingles(*K.raw(b.column("text"))), b.num_rows
        weight = s.count * idf.value[(s.hash & np.uint64(SLOTS - 1)).astype(np.int64)]
        keys = _bands(s, weight, n)
        some = np.diff(s.bounds) > 0
        row = np.repeat(np.arange(n), some * BANDS)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("text_key"), pa.array(np.diff(s.bounds)), K.listed(keys[some].ravel(), row, n), pa.array(_places(s, weight, n), pa.binary())],
            ["id", "text_key", "size", "bands", "places"],
        )


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _bounds(places: np.ndarray, one: np.ndarray) -> np.ndarray:
    """What the weighted similarity of each row to ``one`` is at most, codes taken at their word; see :func:`_least`."""
    low = _SUMS[np.minimum(places, one)].sum(1)
    bound = low / np.maximum(_SUMS[np.maximum(places, one)].sum(1), 1e-9)
    if one.max() == 255:  # a sum beyond the codes: nothing can be said against another such text
        bound[places.max(1) == 255] = 1
    return bound


def _least(similarity: float) -> float:
    """The least bound of a pair of that similarity: a code is off by half a step at most, either way."""
    return similarity * float(np.exp(-CODE_STEP)) - 1e-6


def _nearest(b: Block, least: float) -> Iterator[tuple[int, int]]:
    """Every text with the likeliest before it (rows come in order of size, the bucket's first text foremost)."""
    for j in range(1, len(b.rep)):
        bound = _bounds(b.places[:j], b.places[j])
        i = int(bound.argmax())
        if bound[i] >= least and b.rep[i] != b.rep[j]:
            yield i, j


def _between(b: Block, least: float) -> Iterator[tuple[int, int]]:
    """All pairs between classes, of two blocks those between them; each by its first common band only."""
    found, codes = np.unique(b.label, return_inverse=True)
    if len(found) < 2:
        return
    most = np.bincount(codes).argmax()
    band = int(np.flatnonzero(b.bands[0] == b.key)[0])
    two = b.side.any()
    for j in np.flatnonzero(b.side == 0) if two else np.flatnonzero(codes != most):
        other = b.side == 1 if two else (codes == most) | (np.arange(len(codes)) < j)
        at = np.flatnonzero((codes != codes[j]) & other)
        at = at[~(b.bands[at, :band] == b.bands[j, :band]).any(1)]
        for i in at[_bounds(b.places[at], b.places[j]) >= least]:
            yield i, j


class Block:
    """Texts of a bucket that meet in one task."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        column = lambda c: rows.column(c).to_numpy() if c in rows.column_names else None
        self.key, self.rep, self.label, self.side = rows.column("key")[0].as_py(), column("rep"), column("label"), column("side")
        self.places = np.frombuffer(b"".join(rows.column("places").to_pylist()), np.uint8).reshape(-1, PLACES)
        self.bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS) if "bands" in rows.column_names else None


def _candidates(batches: Iterator[pa.RecordBatch], similarity: float, pairs_of) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, i and j, so that those of a block are together; one block is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None

    def close() -> Iterator[pa.RecordBatch]:
        b = Block(held)
        if pairs := {(min(b.rep[i], b.rep[j]), max(b.rep[i], b.rep[j])) for i, j in pairs_of(b, _least(similarity))}:
            x, y = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    for batch in batches:
        group = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        edges = np.concatenate(([0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1, [len(group)])) if len(group) else [0]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if held and tuple(group[s]) != last:
                yield from close()
                held = []
            last = tuple(group[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield from close()
    K.give_back()


def _blocks(buckets: DataFrame, sizes: DataFrame, near: int) -> DataFrame:
    """For step 2: ``buckets`` in blocks (``i``) of about ``near`` texts, each with the bucket's first one. sizes: key, n, first (size, rep and places)."""
    rows = buckets.join(sizes.select("key", F.ceil(F.col("n") / near).cast("bigint").alias("blocks")), "key")
    own = rows.select("key", "rep", "size", "places", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).alias("i"))
    first = sizes.where(F.col("n") > near).select("key", "first.rep", F.lit(0).cast("bigint").alias("size"), "first.places", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / near).cast("bigint") - 1)).alias("i"))
    return own.union(first).withColumn("j", F.lit(0).cast("bigint")).repartition("key", "i").sortWithinPartitions("key", "i", "j", "size", "rep")


def _dealt_blocks(named: DataFrame, run: int) -> DataFrame:
    """The rows of buckets of several classes, dealt out for step 4: each bucket at once, or in pairs of blocks beyond ``run`` rows.

    Of such a bucket, the texts outside its largest class form blocks of half a run that meet themselves, each other (``i`` and ``j``) and
    all blocks of the largest class (``i`` and -1 - ``j``). A row goes out once for each block that its own meets.
    """
    columns = ["key", "rep", "places", "bands", "label"]
    # buckets whose texts are all in one class by now have nothing left to find; a bucket's classes are counted in the map tasks first
    per = cut(named.groupBy("key", "label").agg(F.count("*").alias("m")))
    open_ = cut(per.groupBy("key").agg(F.sum("m").alias("n"), F.count("*").alias("classes"), F.max(F.struct("m", "label")).alias("top")).where("classes > 1"))
    rows = named.join(open_, "key")
    place = lambda i, j, side: F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), (side if isinstance(side, Column) else F.lit(side)).cast("bigint").alias("side"))
    blocks = lambda n: F.ceil(n / max(1, run // 2))
    rows = rows.withColumns({"most": F.col("label") == F.col("top.label"), "n_rest": blocks(F.col("n") - F.col("top.m")), "n_most": blocks(F.col("top.m"))})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("most"), F.col("n_most")).otherwise(F.col("n_rest"))))
    own, all_of = F.col("own"), lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    with_rest = F.transform(all_of("n_rest"), lambda y: place(F.least(own, y), F.greatest(own, y), (own > y).cast("bigint")))
    with_most = F.transform(all_of("n_most"), lambda y: place(own, -1 - y, 0))
    of_most = F.transform(all_of("n_rest"), lambda y: place(y, -1 - own, 1))
    where = F.when(F.col("n") <= run, F.array(place(F.lit(0), F.lit(0), 0))).when(F.col("most"), of_most).otherwise(F.concat(with_rest, with_most))
    return rows.select(*columns, F.inline(where)).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")


def _verify(batches: Iterator[pa.RecordBatch], idf, similarity: float) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches, "text_a"):
        a, c, n = Shingles(*K.raw(b.column("text_a"))), Shingles(*K.raw(b.column("text_b"))), b.num_rows
        text, hashes = np.concatenate((a.text, c.text)), np.concatenate((a.hash, c.hash))
        codes, found = pd.factorize(K.within(text, hashes))
        weight = np.concatenate((a.count, c.count)) * idf.value[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
        m = len(a.text)
        one, two = (np.bincount(codes[x], weight[x], len(found)) for x in (slice(0, m), slice(m, None)))
        row = np.zeros(len(found), np.int64)
        row[codes] = text
        weighted = np.bincount(row, np.minimum(one, two), n) / np.maximum(np.bincount(row, np.maximum(one, two), n), 1e-9)
        link = weighted >= similarity - 1e-9
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(link)), b.column("b").filter(pa.array(link)), pa.array(weighted[link])], ["a", "b", "similarity"])


def classes(docs: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY, near: int = NEAR, run: int = RUN) -> DataFrame:
    """One row per document: the key, class_id (the smallest key of its class) and class_size, its documents."""
    return _classes(docs.select(F.col(key).alias("id"), "text"), similarity, near, run).select(F.col("id").alias(key), "class_id", "class_size")


def _classes(rows: DataFrame, similarity: float, near: int = NEAR, run: int = RUN) -> DataFrame:
    """rows: id, text. Returns id, text_key, a label of the class, and the columns of :func:`classes`."""
    spark = rows.sparkSession
    idf = spark.sparkContext.broadcast(weights(rows))  # SLOTS numbers
    keyed = rows.select("id", text_key(F.col("text")).alias("text_key"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    signed = keyed.mapInArrow(lambda batches: _signatures(batches, idf), f"id {kind}, text_key binary, size bigint, bands array<bigint>, places binary")
    # a row for each different text: copies meet in the map tasks first
    texts = signed.groupBy("text_key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("places").alias("places"))
    texts = cut(texts).withColumn("rep", F.monotonically_increasing_id())  # the rows and their places stay as they were written
    members = texts.select("rep", "size", F.explode("bands").alias("key"))
    sizes = cut(members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("size", "rep")).alias("top")).where("n > 1"))
    buckets = cut(members.select("key", "rep").join(sizes.select("key"), "key").join(texts.select("rep", "size", "places", "bands"), "rep").select("key", "rep", "size", "places", "bands"))
    large = sizes.where(F.col("n") > near).select("key", F.col("top.rep").alias("rep")).join(texts.select("rep", "places"), "rep").select("key", F.struct("rep", "places").alias("first"))
    sizes = sizes.join(large, "key", "left").select("key", "n", "first")

    # the one shuffle of texts: of those that share a band with another, one copy each
    involved = buckets.select("rep").distinct().join(texts.select("rep", "text_key"), "rep")
    whole = stored(keyed.join(involved, "text_key").groupBy("rep").agg(F.first("text").alias("text")), "near-texts")

    def verified(candidates: DataFrame) -> DataFrame:
        pairs = candidates.join(whole.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(whole.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        return pairs.select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: _verify(batches, idf, similarity), "a bigint, b bigint, similarity double")

    pairs = "a bigint, b bigint"
    links = cut(verified(_blocks(buckets, sizes, near).mapInArrow(lambda batches: _candidates(batches, similarity, _nearest), pairs).distinct()))
    labels = components(links)
    named = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    rest = _dealt_blocks(named, run).mapInArrow(lambda batches: _candidates(batches, similarity, _between), pairs).distinct()
    more = cut(verified(rest.join(links.select("a", "b"), ["a", "b"], "left_anti")))
    if more.limit(1).count():
        links = links.union(more)
        labels = components(links)
    of = cut(texts.select("rep", "text_key", "least", "copies").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    whole_class = of.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    by_text = of.join(whole_class, "label").select("text_key", "label", "class_id", "class_size")
    return keyed.select("id", "text_key").join(by_text, "text_key")


def dedup(docs: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the smallest key, and all its columns."""
    names = {c: "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = _classes(rows.select(F.col(names[key]).alias("id"), "text"), similarity)
    # of the texts with the smallest key of a class (several, if keys repeat), the first by its hash
    tops = found.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("label", "id", "text_key").agg(F.count("*").alias("n"))
    stay = cut(tops.groupBy("label").agg(F.min(F.struct("text_key", "n", "id")).alias("top")).select(F.col("top.text_key").alias("stay_key"), F.col("top.id").alias("stay_id"), F.col("top.n").alias("n")))
    met = rows.withColumn("text_key", text_key(F.col("text"))).join(stay, (F.col("text_key") == F.col("stay_key")) & F.col(names[key]).eqNullSafe(F.col("stay_id")))
    once = met.where("n = 1")
    again = met.where("n > 1").groupBy("stay_key", "stay_id").agg(*[F.first(n).alias(n) for n in names.values()])
    return once.select(*names.values()).unionByName(again.select(*names.values())).select(*[F.col(n).alias(c) for c, n in names.items()])
