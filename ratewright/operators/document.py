"""A document of many rows as one file, byte for byte the same however Spark deals the rows out.

The document is one object of canonical JSON: keys in order, small parts from the driver, and long arrays from tables, whose rows are canonical JSON in order
of a key. Brackets, keys and small parts are rows too, with a place before, among or after their array's, so that one range sort puts all text in order. Each task
writes the text of its range to a file; one more task then streams the files, in order, into the document, a buffer at a time. No array is
gathered anywhere.

Defined cases: an empty table is an empty array; a null text or key, or a key that comes twice in an array, is refused, as there would be no order.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, dump
from ..sources.sinks import scratch

BUFFER = 1 << 20
PART = "part int, file string, size bigint"


class NoOrder(ValueError):
    """Rows of an array can't be put in one order."""


def rows_of(df: DataFrame, *key: str) -> DataFrame:
    """key and text: each row as canonical JSON, nulls in it, in order of some columns."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.concat_ws("\x00", *[F.col(k).cast("string") for k in key]).alias("key"), canonical_json(text).alias("text"))


def _parts(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    name, out, size = f"{uuid.uuid4().hex}", None, 0
    for b in batches:
        for text in b.column("text").to_pylist():
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}")
            data = text.encode()
            out.write(data)
            size += len(data)
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [f"{folder}/{name}"], "size": pa.array([size], pa.int64())})


def _joined(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for b in batches:
        for files in b.column("files").to_pylist():
            system, target = fs.FileSystem.from_uri(path)
            system.create_dir(target.rpartition("/")[0], recursive=True)
            digest, size, aside = hashlib.sha256(), 0, f"{target}.{uuid.uuid4().hex}"
            with system.open_output_stream(aside, compression=None) as out:
                for f in files:
                    source, name = fs.FileSystem.from_uri(f["file"])
                    with source.open_input_stream(name) as i:
                        while data := i.read(BUFFER):
                            digest.update(data)
                            size += len(data)
                            out.write(data)
            system.move(aside, target)
            yield pa.RecordBatch.from_pydict({"path": [path], "size": pa.array([size], pa.int64()), "sha256": [digest.hexdigest()]})


def write(spark: SparkSession, small: Mapping[str, object], arrays: Mapping[str, DataFrame], path: str) -> tuple[int, str]:
    """Write the document and return its size and SHA-256. small: values by key; arrays: tables of ``key`` and ``text`` (:func:`rows_of`) by key."""
    names = sorted({*small, *arrays})
    pieces, tables = [], []
    for k, name in enumerate(names):
        head = ("{" if k == 0 else ",") + dump(name) + ":"
        tail = "}" if k + 1 == len(names) else ""
        if name in small:
            pieces.append((k, 0, "", head + dump(small[name]) + tail))
            continue
        shape = arrays[name].agg(F.count("*").alias("n"), F.count("key").alias("keys"), F.count("text").alias("texts"), F.min("key").alias("first")).first()
        if shape.keys != shape.n or shape.texts != shape.n:
            raise NoOrder(f"{name} has rows without a key or a text")
        if twice := arrays[name].groupBy("key").count().where("count > 1").limit(1).collect():
            raise NoOrder(f"{name} has several rows of {twice[0].key!r}")
        pieces += [(k, 0, "", head + "["), (k, 2, "", "]" + tail)]
        comma = F.when(F.col("key") == F.lit(shape.first), "").otherwise(",")
        tables.append(arrays[name].select(F.lit(k).alias("section"), F.lit(1).alias("place"), "key", F.concat(comma, "text").alias("text")))
    rows = spark.createDataFrame(pieces or [(0, 0, "", "{}")], "section int, place int, key string, text string")
    for t in tables:
        rows = rows.unionByName(t)
    folder = scratch(spark, "document")
    order = ["section", "place", "key"]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _parts(batches, folder), PART)
    parts.write.parquet(f"{folder}-parts")
    files = spark.read.schema(PART).parquet(f"{folder}-parts").agg(F.array_sort(F.collect_list(F.struct("part", "file"))).alias("files"))  # names, one for each task
    [done] = files.mapInArrow(lambda batches: _joined(batches, path), "path string, size bigint, sha256 string").collect()
    return done.size, done.sha256
