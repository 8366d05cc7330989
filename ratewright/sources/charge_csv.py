"""``charge_csv``: a Spark data source for charge tables in CSV, whose first three rows are general headers, general values and charge headers.

A row is one CSV row with its cells as an array, whatever their number (quoted newlines belong to a cell). A file that isn't UTF-8 is read as
Latin-1 from its beginning; what a row says about its file is in ``encoding`` and ``bom``. A file that breaks off ends with a row
that has a ``problem``, as one does at a cell of more than ``field_bytes``, an option. A row of index -1 has the SHA-256 of the file's bytes and their number as cells. One task reads one file as a stream.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, InputPartition

from .charge_json import Hashed, batched
from .charge_json import _Reader as _Files

COLUMNS = {"file": pa.string(), "row_index": pa.int64(), "cells": pa.list_(pa.string()), "encoding": pa.string(), "bom": pa.bool_(), "problem": pa.string()}
SCHEMA = "file string, row_index bigint, cells array<string>, encoding string, bom boolean, problem string"
FIELD_BYTES = 10 << 20


def encoding_of(source, chunk: int = 1 << 20) -> tuple[str, bool]:
    """What a whole stream can be read as, and whether it begins with a byte-order mark."""
    decoder, bom, first = codecs.getincrementaldecoder("utf-8")(), False, b""
    try:
        while data := source.read(chunk):
            if len(first) < 3:
                first = (first + data)[:3]
                bom = first == codecs.BOM_UTF8
            decoder.decode(data)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return "latin-1", bom
    return "utf-8-sig", bom


def rows(source, encoding: str, bom: bool, most: int = FIELD_BYTES) -> Iterator[tuple]:
    text = io.TextIOWrapper(source, encoding=encoding, newline="")
    csv.field_size_limit(most)
    k = -1
    try:
        for k, cells in enumerate(csv.reader(text, strict=False)):
            if k == 0 and bom and encoding == "latin-1" and cells:
                cells[0] = cells[0].removeprefix("ï»¿")
            yield k, cells, encoding, bom, None
    except csv.Error as e:
        yield k + 1, None, encoding, bom, str(e)[:300]


class _Reader(_Files):
    def __init__(self, options):
        super().__init__(options)
        self.field_bytes = int(options.get("field_bytes", FIELD_BYTES))

    def read(self, partition: InputPartition):
        yield from batched(((path, *row) for path in partition.value for row in self.file(path)), COLUMNS)

    def file(self, path: str) -> Iterator[tuple]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_stream(name, compression=self.compression) as source:
            hashed = Hashed(source)
            encoding, bom = encoding_of(hashed)
            digest, size = hashed.identity()
        with system.open_input_stream(name, compression=self.compression) as source:
            yield -1, [digest, str(size)], encoding, bom, None
            yield from rows(source, encoding, bom, self.field_bytes)


class ChargeCsv(DataSource):
    @classmethod
    def name(cls):
        return "charge_csv"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
