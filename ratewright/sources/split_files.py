"""Large charge documents read by many tasks, with the rows that one stream would give.

A file is cut into chunks of bytes anywhere, inside escapes, quotes and characters too. What a chunk does to the reader's state is
worked out for every state it may begin in, by one task a chunk; the states are then composed from the first chunk to the last, so that
each chunk knows its own, and a second scan finds the places where an element (JSON) or a row (CSV) begins. The ranges between such
places are read in parallel by the stream's own code.

Nothing is taken on trust: a range must end exactly where the next begins, with as many elements as were counted there (JSON), or
with the reader between two rows (CSV). By induction from the first range, ranges that all agree are the stream's own steps. Files in which
one disagrees, or whose grammar breaks anywhere, are read by one task as a stream, as small files are.

Rows are written to a table in the shared folder, as agreement is known when all was read. Only the states and a few places of each
chunk are gathered for a file (one chunk is megabytes), never its text; the digest of a whole file, which is sequential, is a task of its own beside the others.

Defined cases: empty files are small; a byte-order mark counts for the whole file; a file that isn't UTF-8 in any chunk is Latin-1 as a whole (CSV); arrays
whose key lies further than ``BACK`` bytes before their bracket are read with the rest of the document, by one task.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import charge_csv, charge_json
from .charge_json import ARRAYS, Broken, Hashed, Text, batched, listing, problem, scan
from .sinks import scratch

CHUNK = 8 << 20
#: Files of more bytes are split.
LARGE = 64 << 20
#: Bytes before an array's bracket in which its key is looked for.
BACK = 1 << 12
TASKS = 20_000

_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")[ \t\n\r]*:[ \t\n\r]*\Z', re.S)
_OPEN = np.zeros(256, np.int8)
_OPEN[list(b"{[")], _OPEN[list(b"}]")] = 1, -1
_MARKS = np.zeros(256, bool)
_MARKS[list(b"{}[],")] = True


def read_at(file: str, start: int, size: int) -> bytes:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(file)
    with system.open_input_file(name) as source:
        source.seek(start)
        return source.read(size)


class Marks:
    """The quotes of a chunk that aren't escaped, and its brackets and commas. escaped: the byte before the chunk is a backslash that escapes."""

    def __init__(self, data: np.ndarray, escaped: bool = False):
        self.data = data
        quotes, slashes = np.flatnonzero(data == 34), np.flatnonzero(data == 92)
        starts = slashes[np.diff(slashes, prepend=-2) != 1]  # of runs of backslashes

        def odd(at: np.ndarray) -> np.ndarray:
            """Whether an odd number of backslashes is right before each place."""
            after = np.zeros(len(at), bool)
            inner = at > 0
            after[inner] = data[at[inner] - 1] == 92
            start = np.full(len(at), -1)
            if len(starts):
                start[after] = starts[np.searchsorted(starts, at[after] - 1, side="right") - 1]
            run = np.where(after, at - start, 0)
            begins = np.where(after, start == 0, at == 0)
            return ((run + (begins & escaped)) & 1).astype(bool)

        self.quotes = quotes[~odd(quotes)]
        self.escapes = bool(odd(np.array([len(data)]))[0])
        self.at = np.flatnonzero(_MARKS[data])
        self.inside = (np.searchsorted(self.quotes, self.at) & 1).astype(bool)  # if the chunk begins outside a string

    def leave(self, string: bool) -> tuple[int, int]:
        """The state after the chunk (0 outside strings, 1 inside, 2 inside after a backslash that escapes) and the change of depth."""
        own = self.at[self.inside == string]
        ends = (len(self.quotes) & 1) ^ string
        return (2 if self.escapes else 1) if ends else 0, int(_OPEN[self.data[own]].sum(dtype=np.int64))


def _json_states(file: str, start: int, size: int) -> list[dict]:
    data = np.frombuffer(read_at(file, start, size), np.uint8)
    plain = Marks(data)
    escaped = Marks(data, True) if len(data) and data[0] in (34, 92) else plain
    return [dict(zip(("to", "deeper"), m.leave(s), strict=True)) for m, s in ((plain, False), (plain, True), (escaped, True))]


def _json_events(file: str, start: int, size: int, state: int, depth: int) -> list[dict]:
    """What happens to the top level's values in a chunk: one opens (an array with its key), has commas of its own (the first and how many), closes."""
    lead = min(start, BACK)
    raw = read_at(file, start - lead, size + lead)
    data = np.frombuffer(raw, np.uint8)[lead:]
    m = Marks(data, state == 2)
    at = m.at[m.inside == (state > 0)]
    sign = _OPEN[data[at]]
    after = depth + np.cumsum(sign)
    some = ((sign == 1) & (after == 2)) | ((sign == -1) & (after == 1)) | ((sign == 0) & (after == 2))
    at, sign = at[some], sign[some]
    edges = np.flatnonzero(sign)
    out, before = [], 0
    for e in [*edges.tolist(), len(at)]:
        if e > before:
            out.append({"kind": "commas", "at": start + int(at[before]), "n": e - before, "name": None})
        if e < len(at):
            name = None
            if sign[e] == 1 and data[at[e]] == 91:
                place = lead + int(at[e])
                found = _KEY.search(raw[max(0, place - BACK) : place])
                try:
                    name = json.loads(found[1]) if found else None
                except ValueError:
                    pass
            out.append({"kind": "open" if sign[e] == 1 else "close", "at": start + int(at[e]), "n": 0, "name": name})
        before = e + 1
    return out


def _json_ranges(chunks: list[dict], arrays: tuple[str, ...]) -> tuple[list[dict], list[dict]]:
    """Ranges of elements between a bracket or comma and the next chunk's first, and where the arrays open and close."""
    ranges, closed, now = [], [], None
    for e in (e for c in chunks for e in c["events"]):
        if e["kind"] == "open" and e["name"] in arrays:
            now = {"name": e["name"], "open": e["at"], "n": 1, "first": len(ranges)}
            ranges.append({"name": e["name"], "start": e["at"] + 1, "ordinal": 0})
        elif now and e["kind"] == "commas":
            ranges[-1]["end"], ranges[-1]["n"] = e["at"], now["n"] - ranges[-1]["ordinal"]
            ranges.append({"name": now["name"], "start": e["at"] + 1, "ordinal": now["n"]})
            now["n"] += e["n"]
        elif now and e["kind"] == "close":
            ranges[-1]["end"], ranges[-1]["n"] = e["at"], now["n"] - ranges[-1]["ordinal"]
            closed.append({"open": now["open"], "close": e["at"], "name": now["name"], "n": now["n"]})
            now = None
    return ([r for r in ranges if "end" in r], closed) if now is None else ([], [])


class _Spliced:
    """A file without the elements of its large arrays: what is between their brackets is left out."""

    def __init__(self, file: str, size: int, closed: list[dict]):
        self.file, self.parts, at = file, [], 0
        for c in closed:
            self.parts.append((at, c["open"] + 1))
            at = c["close"]
        self.parts.append((at, size))

    def read(self, n: int) -> bytes:
        while self.parts:
            start, end = self.parts[0]
            if start < end:
                data = read_at(self.file, start, min(n, end - start))
                self.parts[0] = start + len(data), end
                return data
            self.parts.pop(0)
        return b""


class _Doubt(Exception):
    """What was counted and what was read differ."""


def _elements(data: bytes, name: str, ordinal: int, n: int, empty: bool, bom: bool) -> Iterator[tuple]:
    text = Text(io.BytesIO(data))
    if text.bom:
        text.at -= 1
    if not text.peek():
        if not empty:
            raise _Doubt
        return
    for k in range(ordinal, ordinal + n):
        raw = text.value()
        bad = None if isinstance(text.last, dict) and text.whole else problem(raw)
        yield name, None, k, raw.encode("utf-8", "replace").decode() if bad else raw, bad, bom
        more = text.peek()
        if k + 1 < ordinal + n:
            if more != ",":
                raise _Doubt
            text.at += 1
        elif more:
            raise _Doubt


def _json_rows(task: dict) -> Iterator[tuple]:
    file, bom = task["file"], task["bom"]
    try:
        if task["kind"] == "digest":
            yield "source", "sha256", *_identity(file), None, None
        elif task["kind"] == "rest":
            counts = {c["name"]: c for c in task["closed"]}
            for part, name, ordinal, payload, why, mark in scan(_Spliced(file, task["size"], task["closed"])):
                if part == "stream":
                    raise _Doubt
                if part == "end" and name in counts:
                    ordinal = 0 if counts[name]["empty"] else counts[name]["n"]
                yield part, name, ordinal, payload, why, mark
        else:
            yield from _elements(read_at(file, task["start"], task["end"] - task["start"]), task["name"], task["ordinal"], task["n"], task["empty"], bom)
    except (_Doubt, Broken):
        yield "?", None, None, None, None, None


def _identity(file: str) -> tuple[int, str]:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(file)
    with system.open_input_stream(name, compression=None) as source:
        digest, size = Hashed(source).identity()
    return size, digest


def _each(df: DataFrame, own: Callable[[dict], Iterator[dict]], schema: str, kinds: pa.Schema) -> DataFrame:
    """Rows of ``own`` for each row, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pylist(list(own(r)), kinds)

    return df.mapInArrow(run, schema)


def _chunks(spark: SparkSession, files: list[tuple[str, int]], chunk: int, tasks: int) -> DataFrame:
    rows = spark.createDataFrame(files, "file string, size bigint")
    each = rows.select("file", "size", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / chunk).cast("bigint"))).alias("k")).select("file", "size", "k", (F.col("k") * chunk).alias("start"))
    return each.withColumn("length", F.least(F.lit(chunk), F.col("size") - F.col("start"))).repartition(min(tasks, sum(-(-s // chunk) for _, s in files)))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _gathered(df: DataFrame, *columns: str) -> DataFrame:
    """What was found out about each chunk of a file, in order."""
    return df.groupBy("file", "size").agg(F.array_sort(F.collect_list(F.struct("k", *columns))).alias("chunks"))


def _finish(spark: SparkSession, source: type, files: list[tuple[str, int]], rows: DataFrame | None, doubtful: DataFrame | None, small: list[tuple[str, int]]) -> DataFrame:
    """The rows of files without a doubt, and all other files as streams."""
    spark.dataSource.register(source)
    bad = {r.file for r in doubtful.select("file").distinct().collect()} if doubtful is not None else set()
    streams = [*small, *[f for f in files if f[0] in bad]]
    streamed = spark.read.format(source.name()).option("files", json.dumps(streams)).load()
    if rows is None:
        return streamed
    good = rows.where(~F.col("file").isin(sorted(bad))) if bad else rows
    return good.unionByName(streamed) if streams else good


def read_json(spark: SparkSession, path: str, chunk: int = CHUNK, large: int = LARGE, arrays: tuple[str, ...] = ARRAYS, most_tasks: int = TASKS) -> DataFrame:
    """The rows of ``charge_json`` for every file at a path; files over ``large`` bytes are read by a task for each chunk."""
    found = listing(path)
    files, small = [f for f in found if f[1] > large], [f for f in found if f[1] <= large]
    if not files:
        return _finish(spark, charge_json.ChargeJson, [], None, None, small)
    state = pa.struct([("to", pa.int32()), ("deeper", pa.int64())])
    chunks = _chunks(spark, files, chunk, most_tasks)
    keys = "file string, size bigint, k bigint, start bigint, length bigint"
    own = [pa.field(c, pa.string() if c == "file" else pa.int64()) for c in ("file", "size", "k", "start", "length")]
    states = _each(chunks, lambda r: [r | {"leaves": _json_states(r["file"], r["start"], r["length"])}], f"{keys}, leaves array<struct<to:int,deeper:bigint>>", pa.schema([*own, pa.field("leaves", pa.list_(state))]))

    def entered(r: dict) -> Iterator[dict]:
        now, depth = 0, 0
        for c in r["chunks"]:
            yield {"file": r["file"], "size": r["size"], "k": c["k"], "start": c["start"], "length": c["length"], "state": now, "depth": depth}
            leave = c["leaves"][now]
            now, depth = leave["to"], depth + leave["deeper"]

    placed = _each(_gathered(states, "start", "length", "leaves"), entered, f"{keys}, state int, depth bigint", pa.schema([*own, pa.field("state", pa.int32()), pa.field("depth", pa.int64())]))
    event = "array<struct<kind:string,at:bigint,n:bigint,name:string>>"
    event_kind = pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("name", pa.string())]))
    spread = placed.repartition(min(most_tasks, sum(-(-s // chunk) for _, s in files)), "file", "k")
    events = _each(spread, lambda r: [{"file": r["file"], "size": r["size"], "k": r["k"], "events": _json_events(r["file"], r["start"], r["length"], r["state"], r["depth"])}], f"file string, size bigint, k bigint, events {event}", pa.schema([*own[:3], pa.field("events", event_kind)]))

    def planned(r: dict) -> Iterator[dict]:
        ranges, closed = _json_ranges(r["chunks"], arrays)
        bom = read_at(r["file"], 0, 3) == codecs.BOM_UTF8
        empty = set()
        for c in closed:  # brackets with white space between them hold no element
            if c["n"] == 1 and not read_at(r["file"], c["open"] + 1, min(c["close"] - c["open"] - 1, BACK)).strip(b" \t\n\r"):
                empty.add(c["open"])
        base = {"file": r["file"], "size": r["size"], "bom": bom, "closed": [], "empty": False}
        yield base | {"kind": "digest"}
        yield base | {"kind": "rest", "closed": [c | {"empty": c["open"] in empty} for c in closed]}
        for x in ranges:
            yield base | {"kind": "range", **x, "empty": x["start"] - 1 in empty}

    closed_kind = pa.list_(pa.struct([("open", pa.int64()), ("close", pa.int64()), ("name", pa.string()), ("n", pa.int64()), ("empty", pa.bool_())]))
    fields = [("file", "string", pa.string()), ("size", "bigint", pa.int64()), ("bom", "boolean", pa.bool_()), ("kind", "string", pa.string()), ("name", "string", pa.string()), *[(c, "bigint", pa.int64()) for c in ("start", "end", "ordinal", "n")], ("empty", "boolean", pa.bool_())]
    tasks = _each(_gathered(events, "events"), planned, ", ".join(f"`{c}` {k}" for c, k, _ in fields) + ", closed array<struct<open:bigint,close:bigint,name:string,n:bigint,empty:boolean>>", pa.schema([*[pa.field(c, k) for c, _, k in fields], pa.field("closed", closed_kind)]))
    tasks = _written(tasks, "json-ranges")
    dealt = tasks.repartition(min(most_tasks, max(1, tasks.count())), "file", "kind", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                yield from batched(((t["file"], *row) for row in _json_rows(t)), charge_json.COLUMNS)

    rows = _written(dealt.mapInArrow(run, charge_json.SCHEMA), "json-rows")
    return _finish(spark, charge_json.ChargeJson, files, rows.where("part <> '?'"), rows.where("part = '?'"), small)


def _utf8_cut(file: str, at: int, size: int) -> int:
    """The first place from ``at`` on that no character begun in the three bytes before it reaches over."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    back = min(3, at)
    for k, b in enumerate(reversed(read_at(file, at - back, back)), 1):
        if b < 0x80:
            break
        if b >= 0xC0:
            length = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return min(size, at + max(0, length - k))
    return at


def _csv_facts(r: dict) -> dict:
    start, end = (_utf8_cut(r["file"], x, r["size"]) for x in (r["start"], r["start"] + r["length"]))
    whole = read_at(r["file"], r["start"], max(end, r["start"] + r["length"]) - r["start"])
    data = np.frombuffer(whole, np.uint8)[: r["length"]]
    try:
        whole[start - r["start"] : end - r["start"]].decode("utf-8")
        utf8 = True
    except UnicodeDecodeError:
        utf8 = False
    # the first row's end in the chunk, if it begins outside quotes and if it begins inside
    quotes, ends = np.flatnonzero(data == 34), np.flatnonzero(data == 10)
    inside = np.searchsorted(quotes, ends) & 1
    first = [int(ends[inside == s][0]) + r["start"] + 1 if (inside == s).any() else -1 for s in (0, 1)]
    return {"file": r["file"], "size": r["size"], "k": r["k"], "odd": bool(len(quotes) & 1), "utf8": utf8, "first": first}


#: A row that no table holds; it comes out alone where the reader is between two rows.
_SENTINEL = "\x00end of range\x00"


def _csv_rows(t: dict) -> Iterator[tuple]:
    """(range, its row's number, cells)."""
    data = read_at(t["file"], t["start"], t["end"] - t["start"])
    first = t["start"] == 0
    if first and t["bom"]:
        data = data.removeprefix(codecs.BOM_UTF8)  # read as Latin-1 it is three letters, which go too
    text = io.StringIO(data.decode("latin-1" if t["encoding"] == "latin-1" else "utf-8"), newline="")
    csv.field_size_limit(charge_csv.FIELD_BYTES)
    last = t["end"] == t["size"]

    def lines() -> Iterator[str]:
        yield from text
        if not last:
            yield _SENTINEL

    held = None
    try:
        for k, cells in enumerate(csv.reader(lines(), strict=False)):
            if held is not None:
                yield t["start"], k - 1, held
            held = cells
    except csv.Error:
        yield t["start"], -1, None
        return
    if last:
        if held is not None:
            yield t["start"], k, held
    elif held != [_SENTINEL]:
        yield t["start"], -1, None


def read_csv(spark: SparkSession, path: str, chunk: int = CHUNK, large: int = LARGE, most_tasks: int = TASKS) -> DataFrame:
    """The rows of ``charge_csv`` for every file at a path; files over ``large`` bytes are read by a task for each chunk."""
    found = listing(path)
    files, small = [f for f in found if f[1] > large], [f for f in found if f[1] <= large]
    if not files:
        return _finish(spark, charge_csv.ChargeCsv, [], None, None, small)
    own = [pa.field(c, k) for c, k in (("file", pa.string()), ("size", pa.int64()), ("k", pa.int64()))]
    facts = _each(_chunks(spark, files, chunk, most_tasks), lambda r: [_csv_facts(r)], "file string, size bigint, k bigint, odd boolean, utf8 boolean, first array<bigint>", pa.schema([*own, pa.field("odd", pa.bool_()), pa.field("utf8", pa.bool_()), pa.field("first", pa.list_(pa.int64()))]))

    def planned(r: dict) -> Iterator[dict]:
        starts, inside = [0], False
        for c in r["chunks"]:
            at = c["first"][inside]
            if c["k"] and 0 < at < r["size"]:
                starts.append(at)
            inside ^= c["odd"]
        bom = read_at(r["file"], 0, 3) == codecs.BOM_UTF8
        encoding = "utf-8-sig" if all(c["utf8"] for c in r["chunks"]) else "latin-1"
        for start, end in zip(starts, [*starts[1:], r["size"]], strict=True):
            yield {"file": r["file"], "size": r["size"], "start": start, "end": end, "encoding": encoding, "bom": bom}

    fields = [("file", "string", pa.string()), *[(c, "bigint", pa.int64()) for c in ("size", "start", "end")], ("encoding", "string", pa.string()), ("bom", "boolean", pa.bool_())]
    tasks = _written(_each(_gathered(facts, "odd", "utf8", "first"), planned, ", ".join(f"`{c}` {k}" for c, k, _ in fields), pa.schema([pa.field(c, k) for c, _, k in fields])), "csv-ranges")
    dealt = tasks.repartition(min(most_tasks, max(1, tasks.count())), "file", "start")
    columns = {"file": pa.string(), "start": pa.int64(), "at": pa.int64(), "cells": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                yield from batched(((t["file"], *row) for row in _csv_rows(t)), columns)

    rows = _written(dealt.mapInArrow(run, "file string, start bigint, at bigint, cells array<string>"), "csv-rows")
    # a row's number in its file: those of the ranges before, from their counts, and its own
    counts = rows.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = tasks.join(counts, ["file", "start"], "left").select("file", "start", "encoding", "bom", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = rows.where("at >= 0").join(before, ["file", "start"]).select("file", (F.col("base") + F.col("at")).alias("row_index"), "cells", "encoding", "bom", F.lit(None).cast("string").alias("problem"))
    digests = _each(tasks.select("file", "encoding", "bom").distinct().repartition("file"), lambda r: [r | dict(zip(("bytes", "digest"), _identity(r["file"]), strict=True))], "file string, encoding string, bom boolean, bytes bigint, digest string", pa.schema([*[pa.field(c, k) for c, _, k in (fields[0], *fields[4:])], pa.field("bytes", pa.int64()), pa.field("digest", pa.string())]))
    digests = digests.select("file", F.lit(-1).cast("bigint").alias("row_index"), F.array("digest", F.col("bytes").cast("string")).alias("cells"), "encoding", "bom", F.lit(None).cast("string").alias("problem"))
    return _finish(spark, charge_csv.ChargeCsv, files, numbered.unionByName(digests), rows.where("at < 0"), small)
