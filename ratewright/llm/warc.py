"""WARC archives of web pages, with an index that is written first and read first.

Writing: a page's record is its own gzip member, a ``response`` with the HTML as payload, or a ``revisit`` without it where
the page with the largest id of those with an equal payload of at least ``revisit_bytes`` holds it. Which is which is settled
by joins on the payload's SHA-1 before anything is written, and only ids and digests are shuffled for it. Tasks write files
under names of their own and return index rows (file, offset, length, URL, digest, ...); the index, checkpointed in the shared
folder, names only records of tasks that counted.

Reading: chosen index rows are dealt out by file and range, sorted by offset, and neighbouring ranges are read at once; a
member is then unpacked and its headers and digest are checked against the index. A revisit's payload size is that of the
record it refers to.

Defined cases: a null HTML is an empty payload; a null URL is written as an empty target; rows with the id
of the response and its payload are responses too; a null id is never referred to, and payloads of null ids alone are all
responses; an empty table gives an empty
index; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import TASKS, cut, scratch
from .token_files import files

LEVEL = 1
#: Bytes of archives that one task reads, about.
TASK_BYTES = 16 << 20
GAP, MOST = 1 << 16, 8 << 20
DATE = "2026-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(digest_: str, page_id: int | None) -> str:
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}:{digest_}").urn


def one_line(value: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest_: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    body = HTTP % len(payload) + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(digest_, page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest_}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(digest_, refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n].partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    out = path = None
    at = 0
    for b in K.slices(batches, "html"):
        if out is None:
            system, base = files(folder)
            system.create_dir(base)
            path = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
            out = system.open_output_stream(f"{base}/{path}", compression=None)
        found = []
        for page_id, url, html, holder, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "holder", "first")), strict=True):
            payload = (html or "").encode()
            d = digest(payload)
            data = _gzip(record(page_id, url, payload, d, holder, not first))
            out.write(data)
            found.append((page_id, url, f"{folder}/{path}", at, len(data), d, len(payload), "response" if first else "revisit", None if first else holder))
            at += len(data)
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True) if found else [[]] * len(names), kinds, strict=True)], names)
    if out:
        out.close()


def write(pages: DataFrame, folder: str, revisit_bytes: int = 0) -> DataFrame:
    """Write a record for each page and return the index."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("key"))
    # one row per payload: a group of any size is reduced to its largest id in the map tasks
    holders = rows.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= revisit_bytes).groupBy("key").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    marked = rows.join(holders.where("n > 1 and holder is not null").drop("n"), "key", "left").select("page_id", "url", "html", "holder", (F.col("holder").isNull() | (F.col("holder") == F.col("page_id"))).alias("first"))
    marked = marked.withColumn("first", F.coalesce("first", F.lit(False)))
    return cut(marked.mapInArrow(lambda batches: _write(batches, folder), INDEX))


def _ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Index rows of one file by offset, in groups whose ranges are read at once."""
    group: list[dict] = []
    for r in rows:
        if group and (r["file"] != group[0]["file"] or r["offset"] - group[-1]["offset"] - group[-1]["length"] > GAP or r["offset"] + r["length"] - group[0]["offset"] > MOST):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    name, source = None, None
    for b in batches:
        found = []
        for group in _ranges(b.to_pylist()):
            if group[0]["file"] != name:
                name = group[0]["file"]
                folder, _, file = name.rpartition("/")
                system, base = files(folder)
                source = system.open_input_file(f"{base}/{file}")
            start = group[0]["offset"]
            source.seek(start)
            block = source.read(group[-1]["offset"] + group[-1]["length"] - start)
            for r in group:
                headers, payload = parse(zlib.decompress(block[r["offset"] - start : r["offset"] - start + r["length"]], 31))
                d, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                if d != r["payload_digest"] or headers["warc-record-id"] != f"<{record_id(d, r['page_id'])}>" or kind != r["record_type"] or kind == "response" and digest(payload) != d:
                    raise ValueError(f"record at {start} of {name} isn't the one in the index")
                to = headers.get("warc-refers-to")
                if to and to != f"<{record_id(d, r['refers_to'])}>":
                    raise ValueError(f"record at {start} of {name} refers to another")
                found.append((r["page_id"], headers["warc-target-uri"], kind, d, len(payload) if kind == "response" else None, r["refers_to"], payload.decode() if with_payload and kind == "response" else None))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["page_id", "url", "record_type", "payload_digest", "own_bytes", "refers_to", "html"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 7, kinds, strict=True)], names)


def read_records(index: DataFrame, chosen: DataFrame | None = None, with_payload: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Records of the index, or of its rows ``chosen`` from it: page_id, url, record_type, payload_digest, payload_bytes, refers_to."""
    rows = (index if chosen is None else chosen).select("page_id", "file", "offset", "length", "payload_digest", "record_type", "refers_to")
    n = max(1, -(-(rows.agg(F.sum("length")).first()[0] or 0) // task_bytes))
    dealt = rows.repartitionByRange(min(int(n), TASKS), "file", "offset").sortWithinPartitions("file", "offset")
    records = dealt.mapInArrow(lambda batches: _read(batches, with_payload), "page_id bigint, url string, record_type string, payload_digest string, own_bytes bigint, refers_to bigint, html string")
    # a revisit takes its size from the index row of the response it refers to
    sizes = index.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("size"))
    out = records.join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.coalesce("own_bytes", "size"))
    return out.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["html"] * with_payload)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to a new folder and return what its archives hold."""
    return read_records(write(pages, scratch(spark, "warc"))).drop("url")
