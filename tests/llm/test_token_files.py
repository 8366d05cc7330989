import io
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from ratewright.llm import token_files as T
from ratewright.llm.common import read, scratch
from ratewright.llm.tokens import public_path


def want(docs):
    library = Tokenizer.from_file(public_path(T.TOKENIZER))
    at, out = 0, []
    for r in sorted(docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_tables(spark, sf):
    docs = read(spark, sf, "documents")
    manifest = T.write(docs, scratch(spark, "t"), file_bytes=200_000)
    assert manifest.count() > 5
    expected = want(docs)
    assert sorted(tuple(r) for r in T.read_back(manifest).collect()) == expected
    few = T.write(docs, scratch(spark, "t"), file_bytes=50_000, tasks=2)
    assert few.count() > 2 and few.selectExpr("part div 1048576 r").distinct().count() == 2
    assert sorted(tuple(r) for r in T.read_back(few).collect()) == expected
    some = [expected[k][0] for k in (0, 17, 18, 500)]
    got = T.read_back(manifest, keys=[*some, 10**12], with_ids=True).collect()
    assert sorted(r.doc_id for r in got) == sorted(some)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_edges(spark):
    docs = spark.createDataFrame([(3, None, 1), (3, None, 2), (None, "x y", 3), (-5, "", 4), (9, "long " * 40_000, 5), (9, "日本 <|endoftext|>", 6)], "doc_id long, text string, part int")
    got = sorted((tuple(r) for r in T.round_trip(spark, docs).collect()), key=lambda r: r[1])
    expected = want(docs)
    assert got == expected  # equal keys in the order of their texts' hashes
    assert T.round_trip(spark, docs.limit(0)).count() == 0


def test_format():
    out = io.BytesIO()
    w = T.FrameWriter(out)
    parts = [np.arange(n, dtype="<u4").tobytes() for n in (1, 5000, 3)]
    for k, p in enumerate(parts):
        w.add(None if k == 2 else k, p)
    w.finish()
    data = out.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(parts)
    assert list(T.FrameReader(io.BytesIO(data), len(data)).ids([0, 2])) == [parts[0], parts[2]]
    damaged = bytearray(data)
    damaged[40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(T.FrameReader(io.BytesIO(bytes(damaged)), len(data)).ids([0, 1, 2]))
