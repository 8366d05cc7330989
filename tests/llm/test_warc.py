import base64
import hashlib
import zlib
from collections import Counter

import duckdb

from ratewright.llm import queries, warc
from ratewright.llm.common import read, scratch


def want(rows):
    top = {}
    for i, html in rows:
        if i is not None:
            top[html or ""] = max(top.get(html or "", i), i)
    n = Counter(html or "" for _, html in rows)
    out = []
    for i, html in rows:
        p = html or ""
        holder = top.get(p) if n[p] > 1 else None
        first = holder is None or holder == i
        out.append((i, len(p.encode()), base64.b32encode(hashlib.sha1(p.encode()).digest()).decode(), "response" if first else "revisit", None if first else holder))
    return sorted(out, key=str)


def test_tables(spark, sf):
    pages = read(spark, sf, "pages")
    got = sorted((tuple(r) for r in queries.op10_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == want([(r.page_id, r.html) for r in pages.collect()])
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(con.execute(queries.ORACLE_SQL["op10_warc"]).fetchall(), key=str) == got


def test_edges(spark):
    rows = [(1, "http://a/\r\nX: y", "same", 1), (5, None, "same", 2), (5, "http://b", "same", 3), (2, "u", None, 4), (3, "u", "", 5), (None, "u", "same", 6), (None, "u", "alone", 7), (None, "v", "alone", 8), (9, "ü", "é" * 100_000, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset long")
    index = warc.write(pages, scratch(spark, "w"))
    got = warc.read_records(index, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want([(r[0], r[2]) for r in rows])
    assert {r.html for r in got if r.record_type == "response"} == {"same", "", "alone", "é" * 100_000}
    some = warc.read_records(index, index.where("page_id = 9 or page_id = 1")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in some) == [(1, 4), (9, 200_000)]
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_archives_are_whole(spark, sf):
    index = warc.write(read(spark, sf, "pages").repartition(3), scratch(spark, "w"))
    at = Counter()
    for r in sorted(index.collect(), key=lambda r: (r.file, r.offset)):
        assert r.offset == at[r.file]
        at[r.file] += r.length
    assert at
    for file, size in at.items():
        data = open(file.removeprefix("file://"), "rb").read()
        assert len(data) == size
        n = 0
        while data:
            d = zlib.decompressobj(31)
            warc.parse(d.decompress(data))
            data, n = d.unused_data, n + 1
        assert n == index.where(index.file == file).count()
