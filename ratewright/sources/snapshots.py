"""Immutable copies of input files, and the metrics of runs."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sinks import scratch

CHUNK = 4 << 20


class Changed(ValueError):
    """Files weren't what they were said to be when they were copied."""


def _copy(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    for b in batches:
        out = []
        for path, want in zip(b.column("path").to_pylist(), b.column("sha256").to_pylist(), strict=True):
            source, name = fs.FileSystem.from_uri(path)
            digest, size, held = hashlib.sha256(), 0, f"{root}/.{uuid.uuid4().hex}"  # each attempt's own
            with source.open_input_stream(name, compression=None) as i, system.open_output_stream(held, compression=None) as o:
                while data := i.read(CHUNK):
                    digest.update(data)
                    size += len(data)
                    o.write(data)
            have = digest.hexdigest()
            good = want is None or have == want
            system.move(held, f"{root}/{have}") if good else system.delete_file(held)
            out.append((path, f"{folder.rstrip('/')}/{have}" if good else None, have, size))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "copy", "sha256", "size"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for b in batches:
        out = []
        for path in b.column("file").to_pylist():
            source, name = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with source.open_input_stream(name, compression=None) as i:
                while data := i.read(CHUNK):
                    digest.update(data)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("size"), pa.array(out, pa.string())], ["file", "size", "sha256"])


def digests(files: DataFrame, tasks: int = 1000) -> DataFrame:
    """files: ``file`` and ``size``. The SHA-256 of each file's bytes; files are read in parallel, a stream each."""
    return files.select("file", "size").repartition(max(1, min(files.count(), tasks))).mapInArrow(_hashed, "file string, size bigint, sha256 string")


def snapshot(files: DataFrame, folder: str) -> DataFrame:
    """files: ``path`` and ``sha256`` (null: not known). Copies each under its digest, a stream at a time in tasks, and returns path, copy, sha256, size.

    A file that isn't what was expected leaves no copy and is refused. The folder must be one that all machines share.
    """
    n = max(1, min(files.count(), 1000))
    done = files.select("path", F.col("sha256").cast("string").alias("sha256")).repartition(n).mapInArrow(lambda batches: _copy(batches, folder), "path string, copy string, sha256 string, size bigint")
    kept = scratch(files.sparkSession, "copies")  # a later use of the result copies nothing again
    done.write.parquet(kept)
    done = files.sparkSession.read.schema(done.schema).parquet(kept)
    bad = done.where("copy is null").agg(F.count("*").alias("n"), F.min("path").alias("first")).first()
    if bad.n:
        raise Changed(f"{bad.n} files changed, such as {bad.first}")
    return done


METRIC = "run_id string, model string, layer string, rows_produced bigint, rows_scanned bigint, bytes_read bigint, bytes_written bigint, wall_ms bigint, measured_at timestamp"


def record_metrics(metrics: DataFrame, root: str) -> None:
    """Append measurements; a later one of the same run and model counts instead of the earlier."""
    metrics.write.mode("append").parquet(f"{root}/metrics")


def latest(metrics: DataFrame) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("run_id", "model").orderBy(F.desc("measured_at")))
    return metrics.withColumn("k", newest).where("k = 1").drop("k")


def metrics(spark: SparkSession, root: str) -> DataFrame:
    return latest(spark.read.schema(METRIC).parquet(f"{root}/metrics"))
