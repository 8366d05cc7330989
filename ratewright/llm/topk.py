"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query in each pass. A pass counts scores in ``BINS`` bins between each query's bounds; the
counts of all tasks are summed up, and the bin that holds the query's k-th score becomes its new bounds, until they are one
value (a score range of 2^17 takes two passes). A last pass keeps what is above that value, and of what equals it the smallest ids.
A task reports the highest bins only, until they hold as many scores as are sought: the k-th score of all is never below that of a part.

Defined cases: rows without a vector or with a null or non-finite component are neither queries nor candidates; candidates with the
query's own id are left out, so that repeated rows don't find each other, and each repeated query has a result of its own; ties go to the smaller id, null ids last; a
query with fewer than k candidates gets all; a null id is no query; components are held to 2^20 in size after scaling, a shorter
vector counts as one with zeros at its end; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .common import cut, unstore

K = 5
BINS = 1024
QUERIES, CANDIDATES = 256, 2048
#: Below any score.
NONE = -(1 << 62)


def _scores(q: V.Tile, c: V.Tile) -> np.ndarray:
    d = min(q.dims, c.dims)
    a, b = q.matrix()[:, :d], c.matrix()[:, :d]
    if V.bound(q, c) < 1 << 53:  # every partial sum is a whole double
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        state = [b.column(f"q_{c}") for c in ("lo", "hi", "remaining")]
        for r in range(b.num_rows):
            q, c = V.Tile(b, r, "q"), V.Tile(b, r, "c")
            yield b.column("q_tile")[r].as_py(), q, c, *[x[r].values.to_numpy() for x in state]


def _counts(batches: Iterator[pa.RecordBatch], bins: int) -> Iterator[pa.RecordBatch]:
    for tile, q, c, lo, hi, remaining in _tiles(batches):
        scores = _scores(q, c)
        row, col = np.nonzero((scores >= lo[:, None]) & (scores <= hi[:, None]) & V.others(q, c) & (lo < hi)[:, None])
        width = -(-(hi - lo + 1) // bins)
        n = np.bincount(row * bins + (scores[row, col] - lo[row]) // width[row], minlength=q.n * bins).reshape(q.n, bins)
        above = n[:, ::-1].cumsum(axis=1)[:, ::-1] - n
        place, at = np.nonzero((n > 0) & (above < remaining[:, None]))
        yield pa.RecordBatch.from_pydict({"tile": np.full(len(place), tile), "place": place.astype(np.int32), "bin": at.astype(np.int32), "n": n[place, at].astype(np.int64)})


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tile, q, c, lo, _, remaining in _tiles(batches):
        scores = _scores(q, c)
        scores[~V.others(q, c)] = NONE
        row, col = np.nonzero((scores >= lo[:, None]) & (scores > NONE))
        # columns are in order of their ids: of scores that equal the k-th, no more than are sought
        level = scores[row, col] == lo[row]
        first = np.concatenate(([0], np.cumsum(np.bincount(row, level, q.n))))[row].astype(np.int64)
        keep = ~level | (np.cumsum(level) - first <= remaining[row])
        row, col = row[keep], col[keep]
        ids = pa.array(c.ids[col], mask=c.nulls[col])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), tile)), pa.array(row.astype(np.int32)), pa.array(q.ids[row]), ids, pa.array(scores[row, col])], ["tile", "place", "query_id", "vec_id", "score"])


def _packed(state: DataFrame) -> DataFrame:
    """The state of each tile's queries, in their order."""
    each = F.array_sort(F.collect_list(F.struct("place", "lo", "hi", "remaining")))
    return state.groupBy("tile").agg(each.alias("s")).select("tile", *[F.col(f"s.{c}").alias(c) for c in ("lo", "hi", "remaining")])


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = V.SCALE, bins: int = BINS, tile: tuple[int, int] = (QUERIES, CANDIDATES)) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest inner products of each row for which ``queries`` holds."""
    rows = V.rows_of(df, key, vector)
    candidates = V.tiles(rows, tile[1], "topk-candidates", scale)
    asked = V.query_tiles(V.rows_of(df.where(queries & F.col(f"`{key}`").isNotNull()), key, vector), tile[0], "topk-queries", scale)
    most = candidates.agg(F.max("norm")).first()[0] or 0.0
    # no inner product is beyond the product of the norms; the slack covers their rounding
    reach = (F.ceil(F.col("norm") * most * (1 + 1e-9)) + 1).cast("bigint")
    state = cut(asked.select("tile", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"), (-reach).alias("lo"), reach.alias("hi"), F.lit(k).cast("bigint").alias("remaining")))
    span = (state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0) + 1
    while span > 1:
        counts = V.meet(asked.join(_packed(state), "tile"), candidates).mapInArrow(lambda batches: _counts(batches, bins), "tile bigint, place int, bin int, n bigint").groupBy("tile", "place", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("tile", "place").orderBy(F.desc("bin"))
        to = counts.withColumn("total", F.sum("n").over(down)).join(state.select("tile", "place", "remaining"), ["tile", "place"]).where("total >= remaining")
        to = to.groupBy("tile", "place").agg(F.max(F.struct("bin", F.col("total"), "n")).alias("b"))
        width = F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(bins)).cast("bigint")
        low = F.col("lo") + F.col("b.bin") * width
        # without a bin that holds it, a query has fewer candidates than are sought
        done = F.col("lo") == F.col("hi")
        next_ = lambda found, none, own: F.when(done, F.col(own)).when(F.col("b").isNull(), F.lit(none)).otherwise(found).cast("bigint").alias(own)
        state = cut(state.join(to, ["tile", "place"], "left").select("tile", "place", next_(low, NONE, "lo"), next_(F.least(F.col("hi"), low + width - 1), NONE, "hi"), next_(F.col("remaining") - F.col("b.total") + F.col("b.n"), 0, "remaining")))
        span = -(-span // bins)
    found = V.meet(asked.join(_packed(state), "tile"), candidates).mapInArrow(_kept, "tile bigint, place int, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("tile", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    found = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    unstore(candidates, asked)
    return found
