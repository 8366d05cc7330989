"""Hard negatives by Four-Russians scoring.

Candidates' components are stored as bit planes: one byte has one bit of eight dimensions of a vector. For each group of eight dimensions,
an anchor's sums over all 256 subsets of them are tabled once; the byte of a plane looks its sum up, shifted by the plane's place, and the
sum over planes and groups is the whole inner product, exactly. The last plane has the sign and is taken off.

First each anchor's positives are found: its highest scores among the other rows of its label. Then, for each positive, the highest
scores among rows of other labels within the band ``least * positive <= 100 * negative <= most * positive``. Each tile pair sends the few rows that can be among
the first, and the rank over all is taken by a window for each anchor, or anchor and positive.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; rows with the anchor's own id are neither
its positives nor its negatives; repeated rows count each, and each repeated anchor has a result of its own; ties go to the smaller id, null ids last; a null id is no anchor;
components are held to 2^20 in size after scaling, a shorter vector counts as one with zeros at its end; anchors without positives, and
positives without negatives, have no row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .common import cut, unstore

POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95
ANCHORS, CANDIDATES = 256, 2048
#: Candidates scored at a time.
STEP = 1024


def subset_sums(eight: np.ndarray, kind: type) -> np.ndarray:
    """Anchors' components of eight dimensions, [8, anchors], to their sums over each subset, [256, anchors]."""
    table = np.zeros((256, eight.shape[1]), kind)
    for k in range(8):
        table[1 << k : 2 << k] = table[: 1 << k] + eight[k]
    return table


class Tables:
    """The subset sums of a tile of anchors, by group of eight dimensions."""

    def __init__(self, q: V.Tile, kind: type):
        matrix = q.matrix().astype(kind)
        groups = -(-q.dims // 8)
        wide = np.pad(matrix, ((0, 0), (0, 8 * groups - q.dims))).T.reshape(groups, 8, q.n)
        self.kind, self.sums = kind, [subset_sums(x, kind) for x in wide]

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """Inner products, [candidates, anchors], of candidates' bit planes [bit, group, candidate]."""
        n, anchors = bits.shape[2], self.sums[0].shape[1] if self.sums else 0
        total, row = np.zeros((n, anchors), self.kind), np.empty((n, anchors), self.kind)
        for table, groups in zip(self.sums, bits.transpose(1, 0, 2), strict=False):  # what one side lacks is zero
            for k, plane in enumerate(groups):
                np.take(table, plane, axis=0, out=row, mode="clip")
                if k:
                    np.left_shift(row, k, out=row)
                np.subtract(total, row, out=total) if k == len(groups) - 1 else np.add(total, row, out=total)
        return total


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Tile number, batch, row, anchors, candidates, where the slice of them begins and ends, scores [anchors, candidates] and their bound."""
    last = None, None, None
    for b in batches:
        for r in range(b.num_rows):
            q, c = V.Tile(b, r, "q"), V.Tile(b, r, "c")
            tile, most = b.column("q_tile")[r].as_py(), V.bound(q, c)
            # of every group, eight components times the planes' values added up, which are under 4 * (reach + 1)
            kind = np.int32 if 32 * q.reach() * (c.reach() + 1) * -(-q.dims // 8) < 1 << 31 else np.int64
            if last[:2] != (tile, kind):
                last = tile, kind, Tables(q, kind)
            bits = c.bits()
            for at in range(0, c.n, STEP):
                to = min(c.n, at + STEP)
                yield tile, b, r, q, c, at, to, np.ascontiguousarray(last[2].scores(bits[:, :, at:to]).T).astype(np.int64), most


def _positives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for tile, _, _, q, c, at, to, scores, most in _scored(batches):
        ok = V.others(q, c)[:, at:to] & (q.labels[:, None] == c.labels[None, at:to])
        row, col = V.best(scores, ok, k, most)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(row), tile)), pa.array(row.astype(np.int32)), pa.array(q.ids[row]), pa.array(c.ids[at + col], mask=c.nulls[at + col]), pa.array(scores[row, col])], ["tile", "place", "anchor_id", "positive_id", "positive_score"]
        )


def _negatives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for tile, b, r, q, c, at, to, scores, most in _scored(batches):
        other = V.others(q, c)[:, at:to] & (q.labels[:, None] != c.labels[None, at:to])
        bands = b.column("q_bands")[r].values.flatten()
        place, number, low, high = (x.to_numpy() for x in bands)
        for j in np.unique(number):
            own = number == j
            some = place[own]
            ok = other[some] & (scores[some] >= low[own][:, None]) & (scores[some] <= high[own][:, None])
            row, col = V.best(scores[some], ok, k, most)
            row = some[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), tile)), pa.array(row.astype(np.int32)), pa.array(np.full(len(row), j, np.int32)), pa.array(c.ids[at + col], mask=c.nulls[at + col]), pa.array(scores[row, col])],
                ["tile", "place", "number", "negative_id", "negative_score"],
            )


def mine(
    df: DataFrame, anchors: Column, label: Column, key: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = V.SCALE, tile: tuple[int, int] = (ANCHORS, CANDIDATES)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the rows for which ``anchors`` holds."""
    candidates = V.tiles(V.rows_of(df, key, vector, label), tile[1], "negatives-candidates", scale, as_planes=True)
    asked = V.query_tiles(V.rows_of(df.where(anchors & F.col(f"`{key}`").isNotNull()), key, vector, label), tile[0], "negatives-anchors", scale)
    near = V.meet(asked, candidates).mapInArrow(lambda batches: _positives(batches, positives), "tile bigint, place int, anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("tile", "place").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last())
    near = cut(near.withColumn("number", F.row_number().over(order)).where(F.col("number") <= positives))
    whole = lambda percent: F.lit(percent) * F.col("positive_score").cast("decimal(20,0)") / 100
    low, high = F.ceil(whole(least)).cast("bigint"), F.floor(whole(most)).cast("bigint")
    bands = near.select("tile", "place", "number", low.alias("low"), high.alias("high")).where("low <= high")
    bands = bands.groupBy("tile").agg(F.collect_list(F.struct("place", "number", "low", "high")).alias("bands"))
    far = V.meet(asked.join(bands, "tile"), candidates).mapInArrow(lambda batches: _negatives(batches, negatives), "tile bigint, place int, number int, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("tile", "place", "number").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last())
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    found = cut(far.join(near, ["tile", "place", "number"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    unstore(candidates, asked)
    return found
