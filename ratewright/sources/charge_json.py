"""``charge_json``: a Spark data source for charge documents, one JSON object around very long arrays.

A row is one array element with its exact text, one top-level field (``part`` = 'envelope', ``name`` = its key), or the end of
a stream that broke off (``part`` = 'stream'). Elements that can't be used (not UTF-8, not JSON, repeated keys, not an object) keep their place and
carry a ``problem``. A last row of each file (``part`` = 'source') has the SHA-256 of its bytes as text and their number as ordinal, so that files
are told apart by content. With ``mode=envelope`` a file is read to its first array, or ``max_bytes``, for its top-level fields alone. With ``compression`` (as zstd or gzip) files are read as what is within them, digests and sizes too. One task reads one file as a stream, a buffer of a few megabytes at a time, so memory follows the largest
element and not the file; files are read in parallel.

    spark.dataSource.register(ChargeJson)
    spark.read.format("charge_json").load("folder or file")
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ARRAYS = ("standard_charge_information", "modifier_information")
CHUNK = 1 << 20
#: Bytes of small files that one task reads, about; a file counts as ``OPENING`` bytes more than it has.
TOGETHER, OPENING = 16 << 20, 4 << 10
COLUMNS = {"file": pa.string(), "part": pa.string(), "name": pa.string(), "ordinal": pa.int64(), "payload_text": pa.string(), "problem": pa.string(), "bom": pa.bool_()}
SCHEMA = "file string, part string, name string, ordinal bigint, payload_text string, problem string, bom boolean"

_SPACE = re.compile(r"[ \t\n\r]*")
_MARK = re.compile(r'["{}\[\]]')
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_LONE = re.compile("[\ud800-\udfff]")
_SCALAR = re.compile(r"[^\s,\]}]+")


class Broken(ValueError):
    """The document's own grammar is broken; what came before stands."""


def _object(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("an object repeats a key")
    return out


_decoder = json.JSONDecoder(object_pairs_hook=_object)
_once = _decoder.scan_once


class Text:
    """A window on a stream of UTF-8; bytes that aren't become lone surrogates."""

    def __init__(self, source, chunk: int = CHUNK):
        self.source, self.chunk = source, chunk
        self.decode = codecs.getincrementaldecoder("utf-8")("surrogateescape").decode
        self.text, self.at, self.ended = "", 0, False
        self.whole = True  # no byte so far was anything but UTF-8
        self.last = None  # the value that was read last, if it is valid
        while not self.text and self.more():
            pass
        self.bom = self.text.startswith("\ufeff")
        self.at += self.bom

    def more(self) -> bool:
        if self.ended:
            return False
        data = self.source.read(self.chunk)
        self.ended = not data
        new = self.decode(data, self.ended)
        self.whole = self.whole and (new.isascii() or not _LONE.search(new))
        self.text = self.text[self.at :] + new
        self.at = 0
        return True

    def peek(self) -> str:
        if self.at < len(self.text) and (c := self.text[self.at]) not in " \t\n\r":
            return c
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def expect(self, c: str, where: str) -> None:
        if self.peek() != c:
            raise Broken(f"expected {c!r} {where}")
        self.at += 1

    def value(self) -> str:
        """The exact text of the value that begins here, whether its inside is valid or not."""
        if not self.peek():
            raise Broken("the document ends inside a value")
        while True:
            try:
                self.last, end = _once(self.text, self.at)
            except (ValueError, RecursionError, StopIteration):
                self.last, end = None, self._end()
            if end is not None and (end < len(self.text) or self.ended):
                out = self.text[self.at : end]
                self.at = end
                return out
            if not self.more():
                raise Broken("the document ends inside a value")

    def _end(self) -> int | None:
        """Where the value's brackets and quotes close; None if not in what was read so far."""
        at, depth = self.at, 0
        if self.text[at] not in '"{[':
            m = _SCALAR.match(self.text, at)
            if not m:
                raise Broken("expected a value")
            return m.end() if m.end() < len(self.text) or self.ended else None
        while True:
            m = _MARK.search(self.text, at)
            if not m:
                return None
            at = m.end()
            if m.group() == '"':
                s = _STRING_END.match(self.text, at)
                if not s:
                    return None
                at = s.end()
            else:
                depth += 1 if m.group() in "{[" else -1
            if depth <= 0:
                return at

    def next_(self, close: str, where: str) -> bool:
        """After a value: whether another follows."""
        c = self.peek()
        self.at += 1
        if c == close:
            return False
        if c != ",":
            raise Broken(f"expected ',' or {close!r} in {where}")
        if self.peek() == close:
            raise Broken(f"trailing comma in {where}")
        return True


def problem(raw: str) -> str | None:
    """Why an element can't be used."""
    try:
        raw.encode()
    except UnicodeEncodeError:
        return "not UTF-8"
    try:
        return None if isinstance(_decoder.decode(raw), dict) else "not an object"
    except (ValueError, RecursionError) as e:
        return f"not usable: {e}"[:300]


class Hashed:
    """A stream that knows the digest of what was read from it, and ends after ``most`` bytes."""

    def __init__(self, source, most: int | None = None):
        self.source, self.most, self.size, self.digest = source, most, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.source.read(n if self.most is None else min(n, self.most - self.size))
        self.size += len(data)
        self.digest.update(data)
        return data

    def identity(self) -> tuple[str, int]:
        """Of all bytes: those that nobody read are read now."""
        while self.read(CHUNK):
            pass
        return self.digest.hexdigest(), self.size


def scan(source, arrays: tuple[str, ...] = ARRAYS, chunk: int = CHUNK, peek: bool = False) -> Iterator[tuple]:
    """(part, name, ordinal, payload_text, problem, bom) of a binary stream. peek: fields before the first array only, as far as they can be read."""
    text = Text(source, chunk)
    bom = text.bom
    seen: set[str] = set()
    try:
        text.expect("{", "at the start")
        if text.peek() == "}":
            text.at += 1
        else:
            while True:
                if text.peek() != '"':
                    raise Broken("expected a key")
                try:
                    key = _decoder.decode(text.value())
                except ValueError as e:
                    raise Broken(f"a key can't be read: {e}") from e
                if key in seen:
                    raise Broken("a top-level key is repeated")
                seen.add(key)
                text.expect(":", "after a key")
                if key in arrays and text.peek() == "[":
                    if peek:
                        return
                    text.at += 1
                    ordinal = 0
                    if text.peek() == "]":
                        text.at += 1
                    else:
                        while True:
                            raw = text.value()
                            bad = None if isinstance(text.last, dict) and text.whole else problem(raw)
                            yield key, None, ordinal, raw.encode("utf-8", "replace").decode() if bad else raw, bad, bom
                            ordinal += 1
                            if not text.next_("]", key):
                                break
                    yield "end", key, ordinal, None, None, bom
                else:
                    raw = text.value()
                    if key in arrays and raw != "null":
                        raise Broken(f"{key} is not an array")
                    try:
                        raw.encode()
                        _decoder.decode(raw)
                    except ValueError as e:
                        raise Broken(f"field {key!r} can't be read") from e
                    yield "envelope", key, None, raw, None, bom
                if not text.next_("}", "the document"):
                    break
        if text.peek():
            raise Broken("content after the document")
    except Broken as e:
        if not peek:
            yield "stream", None, None, None, str(e), bom


def batched(rows: Iterator[tuple], columns: dict[str, pa.DataType], rows_each: int = 500, bytes_each: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, of few rows or few bytes."""
    held, size = [], 0
    long = [k for k, kind in enumerate(columns.values()) if pa.types.is_string(kind) or pa.types.is_list(kind)]
    for row in rows:
        held.append(row)
        for k in long:
            if row[k] is not None:
                size += len(row[k])
        if len(held) >= rows_each or size >= bytes_each:
            yield _batch(held, columns)
            held, size = [], 0
    if held:
        yield _batch(held, columns)


def _batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), columns.values(), strict=True)], list(columns))


def listing(path: str) -> list[tuple[str, int]]:
    """The files at a path, with their sizes; names that begin with ``_`` or ``.`` are left out."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri("file:" + path.removeprefix("file:"))
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    root = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return [(root + f.path, f.size) for f in found]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk = options.get("path", ""), int(options.get("chunk", CHUNK))
        self.files = json.loads(options.get("files", "null"))  # [file, size] of each, instead of a path
        self.peek = options.get("mode", "") == "envelope"
        self.most = int(options.get("max_bytes", CHUNK)) if self.peek else None
        self.compression = options.get("compression")

    def partitions(self):
        found = listing(self.path) if self.files is None else self.files
        # the largest first; small files share a task
        share = min(TOGETHER, max(1 << 20, sum(size + OPENING for _, size in found) // 64))
        parts, room = [], 0
        for file, size in sorted(found, key=lambda f: -f[1]):
            if size + OPENING > room:
                parts.append([])
                room = share
            parts[-1].append(file)
            room -= size + OPENING
        return [InputPartition(p) for p in parts or [[]]]  # Spark reads no partition as None

    def read(self, partition):
        yield from batched(((path, *row) for path in partition.value for row in self.file(path)), COLUMNS)

    def file(self, path: str) -> Iterator[tuple]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_stream(name, compression=self.compression) as source:
            yield from self.rows(Hashed(source, self.most))

    def rows(self, hashed: Hashed) -> Iterator[tuple]:
        yield from scan(hashed, chunk=self.chunk, peek=self.peek)
        if not self.peek:
            digest, size = hashed.identity()
            yield "source", "sha256", size, digest, None, None


class ChargeJson(DataSource):
    @classmethod
    def name(cls):
        return "charge_json"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
