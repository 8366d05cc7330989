"""Shards of near equal bytes by Karmarkar-Karp differencing, with rows of equal text kept together.

Groups (equal texts) are summed in map tasks, so a text of any number of copies is one item. Items are hashed into buckets
of about ``BUCKET`` each; in every bucket, differencing over ``shards`` places repeatedly combines the two partial partitions of the
largest spread, oppositely ordered, and leaves one partial partition: ``shards`` sums. Those of up to ``FAN_IN`` buckets are combined
the same way in one task, level by level, until one is left, so no task and never the driver sees more than a bounded number
of items or sums. The choices are then composed from the top down by joins.

Slots count the rows of a shard from 0 through salted groups whose sizes are added up; no shard is sorted in one task.

Defined cases: a null text has no bytes and forms a group of its own, which is that of the empty text; repeated rows are
rows of one group; a null key is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unsigned32

SHARDS = 40
OVERHEAD = 16
BUCKET = 4096
FAN_IN = 256
#: Rows of a shard that are numbered together, on average at most.
NUMBERED = 50_000


def difference(partials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of sums) into one. Returns its sums and, for each row and place, the place its sum went to."""
    n, k = partials.shape
    sums: list[np.ndarray] = []
    orders = np.argsort(-partials, axis=1, kind="stable")
    heap = []
    for i in range(n):
        s = partials[i][orders[i]]
        sums.append(s)
        heap.append((int(s[-1] - s[0]), i))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        a = heapq.heappop(heap)[1]
        b = heap[0][1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        s = both[order]
        sums[a] = sums[b] = s[:0]
        merges.append((a, b, order))
        sums.append(s)
        heapq.heapreplace(heap, (int(s[-1] - s[0]), len(sums) - 1))
    place: list[np.ndarray | None] = [None] * len(sums)
    place[-1] = np.arange(k)
    for m in range(len(merges) - 1, -1, -1):
        a, b, order = merges[m]
        up = place[n + m]
        place[a], place[b], place[n + m] = np.empty(k, np.int64), np.empty(k, np.int64), None
        place[a][order] = up
        place[b][k - 1 - order] = up
    to = np.empty((n, k), np.int64)
    for i in range(n):
        to[i][orders[i]] = place[i]
    return sums[-1], to


def _items(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    one = np.zeros((len(pdf), shards), np.int64)
    one[:, 0] = pdf["bytes"]
    _, to = difference(one)
    return pd.DataFrame({"bucket": pdf["bucket"], "group": pdf["group"], "bytes": pdf["bytes"], "place": to[:, 0].astype(np.int32)})


def _partials(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    sums, to = difference(np.array(pdf["sums"].tolist(), np.int64))
    return pd.DataFrame({"parent": pdf["parent"], "node": pdf["node"], "to": [x.astype(np.int32) for x in to], "sums": [sums, *[None] * (len(pdf) - 1)]})


def place_groups(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET, fan_in: int = FAN_IN) -> DataFrame:
    """``group`` (long, unique) and ``bytes`` to ``group`` and ``shard``."""
    groups = cut(groups)
    n = max(1, -(-groups.count() // bucket))
    placed = cut(groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(n))).groupBy("bucket").applyInPandas(lambda pdf: _items(pdf, shards), "bucket bigint, group bigint, bytes bigint, place int"))
    sums = placed.groupBy("bucket", "place").agg(F.sum("bytes").alias("bytes")).groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("place", "bytes"))).alias("m"))
    parts = sums.select(F.col("bucket").alias("node"), F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("bigint"))).alias("sums"))
    composed = None
    while True:
        n = max(1, -(-n // fan_in))
        level = cut(parts.withColumn("parent", F.pmod(F.xxhash64(F.lit(n), "node"), F.lit(n)).cast("bigint")).groupBy("parent").applyInPandas(_partials, "parent bigint, node bigint, to array<int>, sums array<bigint>"))
        here = level.select("node", "to", "parent")
        if composed is None:
            composed = here
        else:
            up = here.select(F.col("node").alias("parent"), F.col("to").alias("up"), F.col("parent").alias("above"))
            composed = composed.join(up, "parent").select("node", F.transform("to", lambda x: F.col("up")[x]).alias("to"), F.col("above").alias("parent"))
        if n == 1:
            break
        parts = level.where("sums is not null").select(F.col("parent").alias("node"), "sums")
    return placed.join(composed.select(F.col("node").alias("bucket"), "to"), "bucket").select("group", F.col("to")[F.col("place")].alias("shard"))


def number(rows: DataFrame, order: list[str], shards: int = SHARDS, numbered: int = NUMBERED) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each ``shard``. The rows must not change when computed again."""
    salts = max(8, -(-rows.count() // (shards * numbered)))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = salted.groupBy("shard", "_salt").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = salted.withColumn("_own", F.row_number().over(Window.partitionBy("shard", "_salt").orderBy(*order)) - 1)
    return own.join(before, ["shard", "_salt"]).select(*rows.columns, (F.col("_own") + F.col("_before")).alias("slot"))


def shard(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, bucket: int = BUCKET, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: the key, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col(key).alias("id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("group"))
    shards_of = place_groups(rows.groupBy("group").agg(F.sum("size").alias("bytes")), shards, bucket, fan_in)
    placed = cut(rows.join(shards_of, "group"))
    out = number(placed, ["id", "group"], shards)
    return out.select(F.col("id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
