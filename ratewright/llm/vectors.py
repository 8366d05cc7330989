"""Integer vectors in tiles: what exact scoring of a stated query set against all rows is made of.

A component x becomes ``floor(scale * x)``, x as double. Rows without a vector, or with a null or non-finite component, take no part; what
is beyond ``HELD`` is held there, so that scores fit a long. A shorter vector counts as one with zeros at its end.

A tile is up to so many vectors of one partition as one row of packed bytes, in order of their ids (nulls last), so that a tie is
settled by the column's place. Tiles of queries are dealt out to the parts of the candidates by a join on the part's number: a task
holds one tile of each kind at a time, and work is dealt evenly whatever the vectors are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TASKS, stored

SCALE = 256
HELD = 1 << 20
LEAST = np.iinfo(np.int64).min
TILE = "n int, dims int, low bigint, high bigint, norm double, ids binary, nulls binary, labels binary, data binary"


def rows_of(df: DataFrame, key: str, vector: str, label: Column | None = None) -> DataFrame:
    """id, label and vector of the rows that have a vector."""
    kind = df.schema[vector].dataType.simpleString()
    values = F.col(f"`{vector}`") if kind in ("array<float>", "array<double>") else F.col(f"`{vector}`").cast("array<double>")
    return df.select(F.col(f"`{key}`").cast("bigint").alias("id"), (F.lit(0) if label is None else label).cast("bigint").alias("label"), values.alias("v")).where("v is not null and label is not null")


def _whole(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, nulls, labels and components of the rows that take part; rows of a batch as wide as its widest."""
    for b in batches:
        v = b.column("v")
        flat = v.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components turn into NaN
        size = np.diff(v.offsets.to_numpy())
        row = np.repeat(np.arange(b.num_rows), size)
        ok = np.bincount(row, ~np.isfinite(values), b.num_rows) == 0
        matrix = np.zeros((b.num_rows, int(size.max(initial=0))), np.int32)
        good = ok[row]
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        matrix[row[good], place[good]] = np.floor(np.clip(values[good] * scale, -HELD, HELD))
        ids = b.column("id")
        yield ids.fill_null(0).to_numpy(zero_copy_only=False)[ok], ids.is_null().to_numpy(zero_copy_only=False)[ok], b.column("label").to_numpy(zero_copy_only=False)[ok], matrix[ok]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    width = max(x.shape[1] for x in parts)
    return np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts])


def planes(matrix: np.ndarray, low: int, high: int) -> np.ndarray:
    """Bits of the components, as bytes of eight dimensions each: [bit, group, vector]; the last bit counts negative."""
    bits = max(int(high).bit_length(), int(~low).bit_length() if low < 0 else 0) + 1
    groups = -(-matrix.shape[1] // 8)
    wide = np.pad(matrix, ((0, 0), (0, 8 * groups - matrix.shape[1])))
    each = (wide.T[None] >> np.arange(bits)[:, None, None]) & 1
    return np.packbits(each.reshape(bits, groups, 8, -1).astype(np.uint8), axis=2, bitorder="little")[:, :, 0]


def _tiles(batches: Iterator[pa.RecordBatch], size: int, scale: int, as_planes: bool) -> Iterator[pa.RecordBatch]:
    def packed(ids, nulls, labels, matrix):
        order = np.lexsort((ids, nulls))
        ids, nulls, labels, matrix = ids[order], nulls[order], labels[order], matrix[order]
        low, high = int(matrix.min(initial=0)), int(matrix.max(initial=0))
        norm = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        data = planes(matrix, low, high) if as_planes else matrix.astype(np.int16 if max(-low, high) < 1 << 15 else np.int32)
        row = {"n": len(ids), "dims": matrix.shape[1], "low": low, "high": high, "norm": norm, "ids": ids.tobytes(), "nulls": nulls.tobytes(), "labels": labels.tobytes(), "data": data.tobytes()}
        return pa.RecordBatch.from_pylist([row], pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("norm", pa.float64()), *[(c, pa.binary()) for c in ("ids", "nulls", "labels", "data")]]))

    kept: list[tuple] = []
    held = 0
    for part in _whole(batches, scale):
        while len(part[0]):
            take = size - held
            kept.append(tuple(x[:take] for x in part))
            held += len(kept[-1][0])
            part = tuple(x[take:] for x in part)
            if held == size:
                yield packed(*[np.concatenate(x) for x in list(zip(*kept))[:3]], _joined([x[3] for x in kept]))
                kept, held = [], 0
    if held:
        yield packed(*[np.concatenate(x) for x in list(zip(*kept))[:3]], _joined([x[3] for x in kept]))


def tiles(rows: DataFrame, size: int, name: str, scale: int = SCALE, as_planes: bool = False) -> DataFrame:
    """The rows' tiles as a table of the shared folder, with their number and their part's."""
    packed = rows.mapInArrow(lambda batches: _tiles(batches, size, scale, as_planes), TILE)
    return stored(packed.select(F.monotonically_increasing_id().alias("tile"), F.spark_partition_id().alias("part"), "*"), name)


def query_tiles(rows: DataFrame, size: int, name: str, scale: int = SCALE) -> DataFrame:
    """As :func:`tiles`, dealt anew first: queries are thin in their partitions."""
    count = rows.count()
    return tiles(rows.repartition(max(1, -(-count // size))), size, name, scale)


def meet(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each tile of queries (columns q_*) with each tile of candidates (c_*): queries are dealt out to every part, candidates move once."""
    parts = candidates.agg(F.max("part")).first()[0]
    spread = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], F.explode(F.sequence(F.lit(0), F.lit(-1 if parts is None else parts), F.lit(1)) if parts is not None else F.array().cast("array<int>")).alias("q_to"))
    # dealt out by number, not by bytes: tiles are small and scoring them is the work
    dealt = candidates.select(*[F.col(c).alias(f"c_{c}") for c in candidates.columns]).repartition(min(TASKS, (parts or 0) + 1), "c_part")
    return dealt.join(spread, F.col("c_part") == F.col("q_to"))


class Tile:
    """One side of a row of :func:`meet`, unpacked."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str):
        get = lambda c: batch.column(f"{side}_{c}")[row].as_py()
        self.n, self.dims, self.low, self.high = get("n"), get("dims"), get("low"), get("high")
        self.ids, self.nulls, self.labels = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("nulls"), bool), np.frombuffer(get("labels"), np.int64)
        self.data = get("data")

    def matrix(self) -> np.ndarray:
        return np.frombuffer(self.data, np.int16 if max(-self.low, self.high) < 1 << 15 else np.int32).reshape(self.n, self.dims)

    def bits(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8).reshape(-1, -(-self.dims // 8), self.n)

    def reach(self) -> int:
        return max(-self.low, self.high)


def bound(q: Tile, c: Tile) -> int:
    """No score of the two tiles is beyond it."""
    return q.reach() * c.reach() * min(q.dims, c.dims)


def others(q: Tile, c: Tile) -> np.ndarray:
    """Which candidates have another id than the query (a null id is another one)."""
    return (q.ids[:, None] != c.ids[None]) | q.nulls[:, None] | c.nulls[None]


def best(scores: np.ndarray, ok: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row, of equal ones the first columns. most: a bound of the scores."""
    width = scores.shape[1]
    if (most + 1) * width < 1 << 62:
        keys = np.where(ok, scores * width + np.arange(width - 1, -1, -1), LEAST)
        if k < width:
            return np.nonzero((keys >= np.partition(keys, width - k, axis=1)[:, width - k, None]) & ok)
        return np.nonzero(ok)
    order = np.argsort(np.where(ok, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(scores)), order.shape[1])
    keep = ok[row, order.ravel()]
    return row[keep], order.ravel()[keep]
