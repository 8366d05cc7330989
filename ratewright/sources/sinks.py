"""Charge documents written by Spark: each partition of items becomes one document or table, as a stream of lines."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share: ``spark.checkpoint.dir``, or where that is unset the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends; else they stay until the driver collects its garbage. For queries whose rows are in files by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _document(batches: Iterator[pa.RecordBatch], head: str) -> Iterator[pa.RecordBatch]:
    begun = False
    for b in batches:
        lines = [("," if begun or k else head) + x for k, x in enumerate(b.column(0).to_pylist())]
        begun = begun or bool(lines)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])


def json_head(envelope: dict, array: str = "standard_charge_information") -> str:
    """What a document begins with: the envelope's fields, and the array up to its first element."""
    return json.dumps(envelope)[:-1] + (", " if envelope else "") + json.dumps(array) + ": [\n"


def write_json(items: DataFrame, envelope: dict, path: str, array: str = "standard_charge_information") -> None:
    """items: one string column, the JSON text of an element. The envelope's fields come before the array."""
    head = json_head(envelope, array)
    items.mapInArrow(lambda batches: _document(batches, head), "value string").write.text(path)


def _table(batches: Iterator[pa.RecordBatch], head: list[list[str]]) -> Iterator[pa.RecordBatch]:
    def lines(rows: list[list[str]]) -> pa.RecordBatch:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        return pa.RecordBatch.from_arrays([pa.array([out.getvalue().removesuffix("\n")])], ["value"])

    begun = False
    for b in batches:
        rows = [["" if c is None else c for c in r.values()] for r in b.to_pylist()]
        if rows:
            yield lines([*([] if begun else head), *rows])
            begun = True


#: What a document begins with, what it ends with, and its encoding.
Frame = tuple[str, str, str]


def _documents(batches: Iterator[pa.RecordBatch], folder: str, frames: Mapping[int, Frame], between: str, compression: str | None) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    now, out, begun, aside, tail, encoding, files = None, None, False, "", "", "utf-8", 0
    for b in batches:
        names, kinds, texts = (b.column(c) for c in ("name", "frame", "text"))
        starts = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]]] if len(pc.unique(names)) > 1 else [0]
        for start, end in zip(starts, [*starts[1:], len(names)], strict=True):
            name = names[start].as_py()
            if name != now:
                if out is not None:
                    out.write(tail.encode(encoding))
                    out.close()
                    system.move(aside, f"{root}/{now}")
                head, tail, encoding = frames[kinds[start].as_py()]
                now, begun, aside = name, False, f"{root}/.{name}-{uuid.uuid4().hex}"  # a task that runs twice replaces a file by the same
                out = system.open_output_stream(aside, compression=compression)
                out.write(head.encode(encoding))
                files += 1
            own = [x for x in texts.slice(start, end - start).to_pylist() if x is not None]
            if own:
                out.write(((between if begun else "") + between.join(own)).encode(encoding))
                begun = True
    if out is not None:
        out.write(tail.encode(encoding))
        out.close()
        system.move(aside, f"{root}/{now}")
    yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])


def write_documents(texts: DataFrame, folder: str, frames: Mapping[int, Frame], between: str, compression: str | None = None) -> int:
    """One file for each ``name``, of its rows' ``text`` in their order; the number of files. Rows of a name come together and in one task; the ``frame``
    of a name says what is before and after them. Nulls are left out. A document goes to its file as its rows come, so none is held. The folder is there without rows too."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    written = texts.select("name", "frame", "text").mapInArrow(lambda batches: _documents(batches, folder, frames, between, compression), "files bigint")
    return sum(r.files for r in written.collect())  # a number for each task


def write_csv(rows: DataFrame, general: dict[str, str], path: str) -> None:
    """rows: string columns named as the charge header's columns; nulls are blank cells."""
    head = [list(general), list(general.values()), list(rows.columns)]
    rows.mapInArrow(lambda batches: _table(batches, head), "value string").write.text(path)


def _bodies(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    for b in batches:
        names = b.column("name").to_pylist()
        for name, body in zip(names, b.column("body").to_pylist(), strict=True):
            aside = f"{root}/.{name}-{uuid.uuid4().hex}"  # a task that runs twice replaces a file by the same
            with system.open_output_stream(aside) as out:
                out.write(body or b"")
            system.move(aside, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names]), pa.array([len(x or b"") for x in b.column("body").to_pylist()], pa.int64())], ["file", "size"])


def write_bodies(bodies: DataFrame, folder: str) -> DataFrame:
    """Write each row's ``body`` (binary; null: nothing) as a file of its ``name`` when the result is read: a row of ``file`` and ``size`` for each."""
    return bodies.select("name", "body").mapInArrow(lambda batches: _bodies(batches, folder), "file string, size bigint")
