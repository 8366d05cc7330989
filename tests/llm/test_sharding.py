import random
import zlib
from collections import defaultdict

import numpy as np

from ratewright.llm import sharding as S
from ratewright.llm.common import read


def test_difference_keeps_every_item():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, k = int(rng.integers(1, 40)), int(rng.integers(1, 7))
        items = rng.integers(0, 1000, (n, k))
        sums, to = S.difference(items)
        got = np.zeros(k, np.int64)
        for i in range(n):
            assert sorted(to[i]) == list(range(k))
            got[to[i]] += items[i]
        assert np.array_equal(got, sums)


def plain_differencing(partials):
    """Partitions as sorted lists of sums: the two of the largest spread become one, oppositely ordered, until one is left."""
    parts = [sorted(map(int, p), reverse=True) for p in partials]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return parts[0]


def test_difference_against_the_plain_way():
    rng = np.random.default_rng(5)
    for _ in range(80):
        items = rng.integers(0, 10**9, (int(rng.integers(1, 60)), int(rng.integers(1, 9))))  # spreads hardly ever tie
        assert S.difference(items)[0].tolist() == plain_differencing(items)
    one = np.zeros((200, 40), np.int64)
    one[:, 0] = rng.permutation(np.arange(1, 10**6, 5000))[:200]
    assert sorted(S.difference(one)[0]) == sorted(plain_differencing(one))


def test_two_way_is_the_textbook_result():
    one = np.zeros((5, 2), np.int64)
    one[:, 0] = [8, 7, 6, 5, 4]
    sums, _ = S.difference(one)
    assert abs(int(sums[0] - sums[1])) == 2  # differencing of 8 7 6 5 4 leaves 2


def check(docs, **how):
    rows = S.shard(docs, **how).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want
    by, text = defaultdict(list), defaultdict(set)
    for r in rows:
        by[r.shard].append(r)
        text[r.text_crc32, r.size].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < how.get("shards", 40)
    assert all(len(s) == 1 for s in text.values())
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return [sum(r.size for r in by[k]) for k in range(how.get("shards", 40))]


def test_tables(spark, sf):
    docs = read(spark, sf, "documents")
    sizes = check(docs)
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 40
    # few items in a bucket leave wide spreads, which three levels of combining narrow
    sizes = check(docs, bucket=50, fan_in=3)
    assert max(sizes) - min(sizes) < 0.5 * sum(sizes) / 40


def test_edges(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "hot copy", 0) for i in range(300)] + [(1000 + i, "x" * rng.randint(0, 900), 1) for i in range(600)] + [(None, None, 2), (7, None, 2), (8, "", 2), (8, "", 2), (9, "ü" * 50_000, 2)], "doc_id long, text string, shard int")
    check(docs, bucket=100)
    assert S.shard(docs.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id as id", "0 as shard", "1 as n", "2 as salt", "3 as own", "4 as before")
    got = S.number(clash, ["id"], 1)
    assert got.columns == [*clash.columns, "slot"] and sorted(r.slot for r in got.collect()) == list(range(docs.count()))
