"""``registry``: a folder of JSON lines that only ever changes as a whole.

Lines are in files of their own under ``data``; ``log`` has a file for each version, with the names, sizes and digests of the data files that
version consists of. A write makes its data files first, task by task, and becomes visible by the one new file of the log, which is made
aside and renamed to a name that nobody may have taken: a task that fails, runs twice or is beaten leaves files that no version names, and the
registry as it was. ``append`` adds lines to a version, ``overwrite`` replaces them all.

    spark.dataSource.register(RegistryFiles)
    df.select("value").write.format("registry").mode("append").save("folder")
    spark.read.format("registry").load("folder")            # and .option("version", n) for an earlier one

Assessments are replaced as a whole by :func:`replace_verified`, after all of them, old and new, were verified.

Defined cases: a folder without a log is an empty registry; null and blank values aren't written; a value may have no line break within;
further columns are refused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .sinks import scratch

SCHEMA = "value string"


class Conflict(RuntimeError):
    """Somebody else made the next version meanwhile; nothing of this write is visible."""


class Damaged(ValueError):
    """A data file isn't the one that the log names."""


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "file:" + path.removeprefix("file:"))


def versions(path: str) -> list[int]:
    from pyarrow import fs

    system, root = _at(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))


def files_of(path: str, version: int | None = None) -> list[dict]:
    """The data files of a version (the last one): name, size, sha256 and lines of each."""
    known = versions(path)
    if version is None:
        version = known[-1] if known else 0
    if not version:
        return []
    system, root = _at(path)
    with system.open_input_stream(f"{root}/log/{version:020d}.json") as f:
        return json.loads(f.read())["files"]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, base: int | None = None):
        self.path, self.overwrite = path, overwrite
        self.base = (versions(path) or [0])[-1] if base is None else base  # the version that this write follows

    def write(self, iterator: Iterator) -> Written:
        name = f"data/{uuid.uuid4().hex}.jsonl"  # each attempt of each task has its own
        digest, size, lines, out = hashlib.sha256(), 0, 0, None
        system, root = _at(self.path)
        for row in iterator:
            value = row.value
            if value is None or not value.strip():
                continue
            if "\n" in value or "\r" in value:
                raise ValueError("a record has a line break")
            if out is None:
                system.create_dir(f"{root}/data", recursive=True)
                out = system.open_output_stream(f"{root}/{name}")
            data = value.encode() + b"\n"
            out.write(data)
            digest.update(data)
            size, lines = size + len(data), lines + 1
        if out is None:
            return Written([])
        out.close()
        return Written([{"name": name, "size": size, "sha256": digest.hexdigest(), "lines": lines}])

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        new = [f for m in messages if m for f in m.files]
        system, root = _at(self.path)
        kept = [] if self.overwrite else files_of(self.path, self.base)
        system.create_dir(f"{root}/log", recursive=True)
        target, aside = f"{root}/log/{self.base + 1:020d}.json", f"{root}/log/.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as f:
            f.write(json.dumps({"files": kept + new}, sort_keys=True).encode())
        try:
            if isinstance(system, fs.LocalFileSystem):
                import os

                try:
                    os.link(aside, target)  # fails if the name is taken
                except FileExistsError as e:
                    raise Conflict(f"version {self.base + 1} exists") from e
            else:
                if system.get_file_info(target).type != fs.FileType.NotFound:
                    raise Conflict(f"version {self.base + 1} exists")
                system.move(aside, target)
                return
        except Conflict:
            self.abort(messages)
            raise
        finally:
            if system.get_file_info(aside).type != fs.FileType.NotFound:
                system.delete_file(aside)

    def abort(self, messages: list[Written | None]) -> None:
        """Files of tasks that ended are deleted; those of others are named by nobody."""
        from pyarrow import fs

        system, root = _at(self.path)
        for f in (f for m in messages if m for f in m.files):
            if system.get_file_info(f"{root}/{f['name']}").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/{f['name']}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, version: int | None):
        self.path, self.version = path, version

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in files_of(self.path, self.version)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        f = partition.value
        if f is None:
            return
        system, root = _at(self.path)
        digest, rest, size = hashlib.sha256(), b"", 0
        with system.open_input_stream(f"{root}/{f['name']}", compression=None) as source:
            while data := source.read(1 << 20):
                digest.update(data)
                size += len(data)
                *lines, rest = (rest + data).split(b"\n")
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], ["value"])
        if (size, digest.hexdigest()) != (f["size"], f["sha256"]):
            raise Damaged(f"{f['name']} isn't what was written")


class RegistryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        version = self.options.get("version")
        return _Reader(self.options["path"], int(version) if version else None)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["value"]:
            raise ValueError("a registry has one column, value")
        base = self.options.get("base")
        return _Writer(self.options["path"], overwrite, int(base) if base else None)


def append(records: DataFrame, path: str) -> None:
    """Add the lines of ``value``."""
    records.sparkSession.dataSource.register(RegistryFiles)
    records.select("value").write.format("registry").mode("append").save(path)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    spark.dataSource.register(RegistryFiles)
    reader = spark.read.format("registry")
    return (reader if version is None else reader.option("version", version)).load(path)


def replace_verified(records: DataFrame, path: str) -> None:
    """Replace an assessment registry by its own lines and new ones, if every one of them is good and no assessment is there twice."""
    from ..operators.records import verify
    from .registries import BadRecords, require_good

    spark, base = records.sparkSession, (versions(path) or [0])[-1]
    # what is verified is what is written: the lines, of the version that this one follows and new ones, are kept aside first
    kept = scratch(spark, "registry")
    read(spark, path, base).unionByName(records.select("value")).write.parquet(kept)
    every = spark.read.schema(SCHEMA).parquet(kept)
    told = scratch(spark, "registry-verified")
    verify(every).select("assessment_id", "problem").write.parquet(told)  # once, for both questions
    checked = spark.read.schema("assessment_id string, problem string").parquet(told)
    require_good(checked)
    twice = checked.groupBy("assessment_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise BadRecords(f"assessment {twice[0].assessment_id} is there twice")
    every.write.format("registry").option("base", base).mode("overwrite").save(path)
