"""Best-fit packing of documents into token sequences by bin completion.

Documents are cut into pieces of at most ``CAPACITY`` ids. Packing needs only how many pieces there are of each length, a
table of at most ``CAPACITY`` rows at any size of input: the plan is made from it on the driver, and Spark gives each piece
its place. Pieces are ranked within their length (by salted groups, whose sizes are added up, so no length is sorted in one
task), and runs of ranks are joined with the runs of sequences that the plan fills with them.

:func:`search` is bin completion: around the largest piece left it enumerates the fillings that no longer piece, single or put for two
of theirs, improves (others are dominated), with less waste first. A filling is used once to as often as it can; each number is a
branch. A branch ends when its waste, with what the rest must waste (the bounds of Martello and Toth), leaves no fewer sequences than
the incumbent, which begins as best-fit decreasing and is replaced by better ones, found by the search or by best fit below its nodes.
The number of sequences that can't be undercut is returned with the plan, so that a gap shows. ``max_nodes`` and ``max_fillings`` bound
the search; None for both is exact.

Defined cases: a null or empty text is one piece, the end id; repeated rows are documents of their own; an empty table gives
an empty result; null keys are kept; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut
from .tokens import encoder, public_path, with_ends

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Nodes that the search visits, and fillings that it tries around one largest piece; None: all.
MAX_NODES, MAX_FILLINGS = 1000, 64
#: Pieces of a length that are ranked together, on average at most.
RANKED = 200_000

Pattern = tuple[tuple[int, int], ...]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokenizer = encoder(path)
    for b in K.slices(batches):
        ids, counts = with_ends(*tokenizer.encode(*K.raw(b.column("text"))))
        ids = ids.astype("<u4")
        n = -(-counts // capacity)
        row = np.repeat(np.arange(len(counts)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        base = np.cumsum(counts) - counts
        start = piece * capacity
        length = np.minimum(counts[row] - start, capacity)
        at = base[row] + start
        data = memoryview(ids.tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
        out = {"id": b.column("id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64())}
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_pydict(out)


def pieces(docs: DataFrame, key: str = "doc_id", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if wanted, the ids themselves."""
    path, kind = tokenizer or public_path(TOKENIZER), docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("id"), "text").mapInArrow(lambda batches: _pieces(batches, path, capacity, with_ids), schema)


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: for each t, pieces over capacity - t, those over half, and what middle ones of t or more don't find room for there."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    return _bound(counts, capacity)


def _bound(counts: np.ndarray, capacity: int) -> int:
    bytes_ = counts * np.arange(capacity + 1)
    n, total = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(bytes_)))
    half = capacity // 2
    t = np.arange(half + 1)
    alone = n[capacity + 1] - n[capacity - t + 1]  # longer than capacity - t
    over = n[capacity - t + 1] - n[half + 1]  # of the others, over half
    middle = total[half + 1] - total[t]  # from t to half
    room = over * capacity - (total[capacity - t + 1] - total[half + 1])
    return int((alone + over + np.maximum(0, -(-(middle - room) // capacity))).max(initial=0))


def _reach(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """For each place in ``sizes``, the sums up to ``room`` that pieces from there on can have, as bits."""
    out, sums, mask = [0] * (len(sizes) + 1), 1, (1 << room + 1) - 1
    out[-1] = sums
    for k in range(len(sizes) - 1, -1, -1):
        s, n, step = sizes[k], min(left[sizes[k]], room // sizes[k]), 1
        while n > 0:  # 1, 2, 4, ... of them, so any number is a sum of steps
            take = min(step, n)
            sums |= sums << s * take & mask
            n, step = n - take, 2 * step
        out[k] = sums
    return out


def fillings(counts: np.ndarray, room: int, most_waste: int, limit: int | None = None) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``room`` up to ``most_waste`` with lengths that ``counts`` has left, each in falling order, with less waste first."""
    sizes = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    left = {s: int(counts[s]) for s in sizes}
    reach = _reach(sizes, left, room)
    chosen: list[int] = []

    def dominated(waste: int) -> bool:
        # a longer piece that is left, for one of the chosen or for two of them, with what is wasted
        if not waste:
            return False
        ones = set(chosen)
        sums = ones | {x + y for i, x in enumerate(chosen) for y in chosen[i + 1 :]}
        # for one, any longer; for two, as long or longer: one piece for two leaves the shorter ones for other sequences
        return any(left.get(s, 0) > 0 for y in sums for s in range(y + (y in ones), y + waste + 1) if s not in ones or s > y)

    def fill(first: int, space: int) -> Iterator[tuple[int, ...]]:
        """Fillings that use up ``space`` whole."""
        if not space:
            yield tuple(chosen)
            return
        for k in range(first, len(sizes)):
            if not reach[k] >> space & 1:
                return
            s = sizes[k]
            if s <= space and left[s] and reach[k] >> space - s & 1:
                left[s] -= 1
                chosen.append(s)
                yield from fill(k, space - s)
                chosen.pop()
                left[s] += 1

    given = 0
    for waste in range(min(most_waste, room) + 1):
        if not reach[0] >> room - waste & 1:
            continue
        for filling in fill(0, room - waste):
            if not dominated(waste):
                yield filling
                given += 1
                if given == limit:
                    return


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """The first incumbent. Sequences alike in content are handled together."""
    open_: dict[int, dict[Pattern, int]] = {capacity: {(): 10**18}}  # by room: contents and how many are so
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            room = min(r for r, c in open_.items() if r >= size and c)
            have = open_[room]
            content = next(iter(have))
            fit = min(room // size, n)
            times = min(have[content], n // fit)
            if room != capacity:
                have[content] -= times
                if not have[content]:
                    del have[content]
                    if not have:
                        del open_[room]
            into = open_.setdefault(room - fit * size, {})
            new = (*content, (size, fit))
            into[new] = into.get(new, 0) + times
            n -= times * fit
    return [(p, t) for r, c in open_.items() for p, t in c.items() if p]


class Plan(NamedTuple):
    patterns: list[tuple[Pattern, int]]
    sequences: int
    #: No packing has fewer.
    at_least: int


class _Node:
    """Fillings around the largest piece left, those from ``after`` on in order, and what is being tried of them."""

    def __init__(self, top: int, choices: Iterator[tuple[int, ...]]):
        self.top, self.choices = top, choices
        self.pattern: Pattern = ()
        self.used: dict[int, int] = {}
        self.times = 0
        self.gone: set[tuple[int, ...]] = set()  # tried at any number of times before, around this length


def search(histogram: dict[int, int], capacity: int = CAPACITY, max_nodes: int | None = MAX_NODES, max_fillings: int | None = MAX_FILLINGS) -> Plan:
    """Pack pieces, given as {length: how many}, into as few sequences as the search finds."""
    if not histogram:
        return Plan([], 0, 0)
    best = best_fit_decreasing(histogram, capacity)
    used = sum(t for _, t in best)
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    total = int((np.arange(capacity + 1) * counts).sum())
    least = _bound(counts, capacity)
    bins = waste = nodes = 0
    whole = True  # whether all branches were looked at
    stack: list[_Node] = []

    def node(gone: set[tuple[int, ...]]) -> _Node:
        nonlocal whole
        top = int(np.flatnonzero(counts)[-1])
        allowed = (used - 1) * capacity - total - waste  # what the rest may waste in all to be better than the incumbent
        counts[top] -= 1
        found = list(islice((f for f in fillings(counts, capacity - top, allowed) if f not in gone), max_fillings)) if allowed >= 0 else []
        counts[top] += 1
        whole &= max_fillings is None or len(found) < max_fillings
        out = _Node(top, iter(found))
        out.gone = set(gone)
        return out

    def take(pattern_of: dict[int, int], times: int) -> None:
        for s, m in pattern_of.items():
            counts[s] -= m * times

    def below() -> bool:
        """Whether the state can't be better than the incumbent; a better best fit of the rest becomes it."""
        nonlocal best, used
        if bins + _bound(counts, capacity) >= used:
            return True
        if waste > (used - 1) * capacity - total:
            return True
        if nodes <= 16 or not nodes & nodes - 1:
            rest = best_fit_decreasing({int(s): int(counts[s]) for s in np.flatnonzero(counts)}, capacity)
            if (now := bins + sum(t for _, t in rest)) < used:
                best, used = [*((n.pattern, n.times) for n in stack if n.times), *rest], now
        return used <= least

    if used > least:
        stack.append(node(set()))
    while stack and used > least:
        if max_nodes is not None and nodes >= max_nodes:
            whole = False
            break
        at = stack[-1]
        if at.times:  # back from below: one less of the same filling, or the next filling
            size = sum(s * m for s, m in at.used.items())
            take(at.used, -1)
            bins, waste, at.times = bins - 1, waste - (capacity - size), at.times - 1
        if not at.times:
            if at.used:
                at.gone.add(tuple(s for s, m in at.pattern for _ in range(m - (s == at.top))))
            choice = next(at.choices, None)
            if choice is None:
                stack.pop()
                continue
            at.pattern = tuple((s, len(list(g))) for s, g in groupby((at.top, *choice)))
            at.used = dict(at.pattern)
            at.times = min(int(counts[s]) // m for s, m in at.pattern)
            size = sum(s * m for s, m in at.used.items())
            take(at.used, at.times)
            bins, waste = bins + at.times, waste + at.times * (capacity - size)
        nodes += 1
        if not counts.any():
            if bins < used:
                best, used = [(n.pattern, n.times) for n in stack], bins
            continue
        if below():
            continue
        # around the same length, a filling whose number is settled isn't used again
        same = int(np.flatnonzero(counts)[-1]) == at.top
        stack.append(node(at.gone | {tuple(s for s, m in at.pattern for _ in range(m - (s == at.top)))} if same else set()))
    return Plan(best, used, used if whole else least)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, max_nodes: int | None = MAX_NODES, max_fillings: int | None = MAX_FILLINGS) -> list[tuple[Pattern, int]]:
    """Patterns ((length, times in a sequence), ...) and how many sequences have each, together all pieces."""
    return search(histogram, capacity, max_nodes, max_fillings).patterns


def runs(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of the length in each, offset of the first)."""
    out, at, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for size, m in pattern:
            first = at.get(size, 0)
            at[size] = first + m * times
            out.append((size, first, at[size], sequence, m, offset))
            offset += m * size
        sequence += times
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("id", "piece"), max_nodes: int | None = MAX_NODES, max_fillings: int | None = MAX_FILLINGS) -> DataFrame:
    """Give every row with a ``length`` of 1 to ``capacity`` its sequence_id and offset, and say how good the whole is: n_sequences, and least_sequences, which no packing can undercut (equal: proven the fewest)."""
    spark = items.sparkSession
    items = cut(items)  # two jobs need the same rows
    sizes = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    found = search(sizes, capacity, max_nodes, max_fillings)
    table = spark.createDataFrame(runs(found.patterns) or [(0, 0, 0, 0, 1, 0)], "_size bigint, _low bigint, _high bigint, _sequence bigint, _each bigint, _first bigint")
    salts = max(16, -(-sum(sizes.values()) // RANKED))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(before.drop("_n"), ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.coalesce("_before", F.lit(0)))
    # the plan has a few rows for each length, whatever the number of pieces
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    k = F.col("_rank") - F.col("_low")
    whole = [F.lit(n).cast("bigint").alias(c) for n, c in ((found.sequences, "n_sequences"), (found.at_least, "least_sequences"))]
    return placed.select(*items.columns, (F.col("_sequence") + F.floor(k / F.col("_each"))).cast("bigint").alias("sequence_id"), (F.col("_first") + k % F.col("_each") * F.col("length")).cast("bigint").alias("offset"), *whole)


def pack_documents(docs: DataFrame, key: str = "doc_id", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, max_nodes: int | None = MAX_NODES, max_fillings: int | None = MAX_FILLINGS) -> DataFrame:
    """One row per piece: the key, piece, start, length, ids_crc32, sequence_id, offset, n_sequences, least_sequences, and the ids if wanted."""
    out = pack(pieces(docs, key, tokenizer, capacity, with_ids), capacity, max_nodes=max_nodes, max_fillings=max_fillings)
    return out.withColumnRenamed("id", key)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids in order (of rows that carry their ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))
