"""Token ids in seekable zstandard files: a frame for each document, a document index and a seek table.

A file is a run of independent zstandard frames, one for each document and in ascending order of the keys, holding its ids
(little-endian unsigned 32-bit) and the frame's own checksum; then a skippable frame with the key and number of ids of each;
then the seek table of the zstandard seekable format, a skippable frame with the compressed size, size and checksum of every
frame, whose footer ends the file. A reader takes the tail, then only the byte ranges of the documents it is asked for.

Rows are dealt out by ranges of the key, so that the files in turn hold all documents in order and no task holds more than
about ``FILE_BYTES`` of text (many rows with one key are split by text). A task writes a file under a name of its own and
returns its manifest row; the manifest, checkpointed in the shared folder, names only files of tasks that counted, so a lost
executor or a task run twice does no harm. Each task puts its file where ``pyarrow.fs`` resolves the folder's scheme.

Defined cases: a null or empty text is the end id alone; rows with equal keys are in the order of their texts; null keys come
first; an empty table gives no documents; other columns are ignored. Keys are integers.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import TASKS, cut, scratch
from .tokens import encoder, public_path, with_ends

TOKENIZER = "byte_bpe_50k.json"
FILE_BYTES = 32 << 20
#: Files of one range at most.
FILES = 1 << 20
LEVEL = 3
#: Files whose sums are run up together, and ids that a reader hands on at once.
TOGETHER, HANDED = 1000, 1 << 20
# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_DOCUMENT = np.dtype([("key", "<i8"), ("null", "u1"), ("n", "<u4")])

MANIFEST = "part bigint, path string, bytes bigint, documents bigint, ids bigint"


def files(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes one file; ``add`` in the order that readers shall find."""

    def __init__(self, out, level: int = LEVEL):
        import zstandard

        self.out, self.compressor = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.documents: list[tuple[int, int, int]] = []

    def add(self, key: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.documents.append((key or 0, key is None, len(ids) // 4))

    def finish(self) -> None:
        index = np.array(self.documents, _DOCUMENT).tobytes()
        table = np.array(self.entries, _ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)


class FrameReader:
    """Reads chosen documents of one file (any seekable binary file)."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._range(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        table = n * _ENTRY.itemsize + 9
        documents = n * _DOCUMENT.itemsize
        tail = self._range(size - table - documents - 16, 16 + documents + table)
        if struct.unpack_from("<II", tail) != (SKIPPABLE_INDEX, documents) or struct.unpack_from("<II", tail, 8 + documents) != (SKIPPABLE_SEEK_TABLE, table):
            raise ValueError("the index or the seek table is damaged")
        self.documents = np.frombuffer(tail, _DOCUMENT, n, 8)
        self.entries = np.frombuffer(tail, _ENTRY, n, 16 + documents)
        self.ends = np.cumsum(self.entries["packed"].astype(np.int64))

    def _range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, which: list[int], gap: int = 1 << 16, most: int = 4 << 20) -> Iterator[bytes]:
        """Ids of the documents at these places (ascending); frames nearer than ``gap`` are read at once."""
        import xxhash

        starts, k = self.ends - self.entries["packed"], 0
        while k < len(which):
            to = k + 1
            while to < len(which) and starts[which[to]] - self.ends[which[to - 1]] <= gap and self.ends[which[to]] - starts[which[k]] <= most:
                to += 1
            base = int(starts[which[k]])
            block = memoryview(self._range(base, int(self.ends[which[to - 1]]) - base))
            for i in which[k:to]:
                out = self.decompressor.decompress(block[int(starts[i]) - base : int(self.ends[i]) - base], max_output_size=int(self.entries["size"][i]))
                if len(out) != self.entries["size"][i] or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != self.entries["check"][i]:
                    raise ValueError(f"frame {i} is damaged")
                yield out
            k = to


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, level: int, most: int) -> Iterator[pa.RecordBatch]:
    """Files of a range in order, a new one after about ``most`` bytes of text."""
    tokenizer, writer, name, part = encoder(path), None, None, TaskContext.get().partitionId()
    total = held = files_ = 0

    def closed() -> pa.RecordBatch:
        writer.finish()
        size = out.tell()
        out.close()
        return pa.RecordBatch.from_pydict({"part": pa.array([part * FILES + files_], pa.int64()), "path": [f"{folder}/{name}"], "bytes": [size], "documents": [len(writer.entries)], "ids": [total]})

    for b in K.slices(batches):
        if writer is not None and held >= most:
            yield closed()
            writer, total, held, files_ = None, 0, 0, files_ + 1
        if writer is None:
            system, base = files(folder)
            system.create_dir(base)
            name = f"{part:06d}-{files_:06d}-{uuid.uuid4().hex}.tok.zst"
            out = system.open_output_stream(f"{base}/{name}", compression=None)
            writer = FrameWriter(out, level)
        text, offsets = K.raw(b.column("text"))
        ids, counts = with_ends(*tokenizer.encode(text, offsets))
        data, ends = memoryview(ids.astype("<u4").tobytes()), (4 * np.cumsum(counts)).tolist()
        for key, a, e in zip(b.column("key").to_pylist(), [0, *ends], ends, strict=False):
            writer.add(key, bytes(data[a:e]))
        total, held = total + int(counts.sum()), held + len(text)
    if writer:
        yield closed()


def write(docs: DataFrame, folder: str, key: str = "doc_id", tokenizer: str | None = None, level: int = LEVEL, file_bytes: int = FILE_BYTES, tasks: int = TASKS) -> DataFrame:
    """Write the documents' ids and return the manifest: a row per file, in the order of ``part``."""
    path = tokenizer or public_path(TOKENIZER)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), "text")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    # equal keys are in order of their texts' xxhash64, which splits a key with very many rows; "+ 1" keeps one more file than needed on average
    dealt = rows.repartitionByRange(min(int(total // file_bytes) + 1, tasks), "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    return cut(dealt.mapInArrow(lambda batches: _write(batches, folder, path, level, 2 * file_bytes), MANIFEST))


def _open(path: str, size: int) -> FrameReader:
    folder, _, name = path.rpartition("/")
    system, base = files(folder)
    return FrameReader(system.open_input_file(f"{base}/{name}"), size)


def _read(batches: Iterator[pa.RecordBatch], wanted: frozenset | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            reader = _open(row["path"], row["bytes"])
            docs = reader.documents
            starts = row["before"] + np.cumsum(docs["n"].astype(np.int64)) - docs["n"]
            which = np.arange(len(docs)) if wanted is None else np.flatnonzero(np.isin(docs["key"], list(wanted)) & (docs["null"] == 0))
            # few documents or few ids at once; a longer document comes alone
            chunk = np.maximum(np.arange(len(which)) // 4000, np.cumsum(docs["n"][which].astype(np.int64)) // HANDED) if len(which) else which
            for some in np.split(which, np.flatnonzero(np.diff(chunk)) + 1) if len(which) else ():
                keys = pa.array(docs["key"][some].astype(np.int64), mask=docs["null"][some].astype(bool))
                frames = list(reader.ids(some.tolist()))
                out = {"key": keys, "start": starts[some], "n_tokens": docs["n"][some].astype(np.int64), "ids_crc32": pa.array([zlib.crc32(f) for f in frames], pa.int64())}
                if with_ids:
                    at = np.concatenate(([0], np.cumsum(docs["n"][some]))).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(frames), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)


def read_back(manifest: DataFrame, key: str = "doc_id", keys: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """The key, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids; of all documents or of some keys."""
    # running sums in two levels: within groups of files, and over the groups, of which there is one for each TOGETHER files
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    grouped = manifest.withColumn("group", F.floor(F.col("part") / FILES / TOGETHER))
    groups = grouped.groupBy("group").agg(F.sum("ids").alias("of_group")).withColumn("groups_before", F.coalesce(F.sum("of_group").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = grouped.withColumn("own_before", F.coalesce(F.sum("ids").over(up_to.partitionBy("group")), F.lit(0))).join(groups, "group").withColumn("before", F.col("own_before") + F.col("groups_before"))
    n = max(1, min(manifest.count(), TASKS))
    wanted = None if keys is None else frozenset(keys)
    schema = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    spread = placed.select("part", "path", "bytes", "before").repartition(n, "part")
    return spread.mapInArrow(lambda batches: _read(batches, wanted, with_ids), schema).withColumnRenamed("key", key)


def round_trip(spark: SparkSession, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Write all documents to a new folder and return what its files hold."""
    return read_back(write(docs, scratch(spark, "token-files"), key), key)
