import hashlib
import re
from collections import defaultdict

import numpy as np

from ratewright.llm import decontaminate as D
from ratewright.llm.common import read

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return W.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        if w:
            for k in range(max(1, len(w) - 12)):
                windows[tuple(w[k : k + 13])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    found |= got
                    hit.update(range(k, k + n))
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def both_ways(docs, bench):
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in bench.select("item_id", "text").collect()])
    for rows in (1_000_000, 0):
        got = sorted((tuple(r)[:6] for r in D.contamination(docs, bench, broadcast_rows=rows).collect()), key=str)
        assert got == want
    return want


def test_tables(spark, sf):
    want = both_ways(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    assert sum(r[5] for r in want) > 0


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Alpha beta"), (3, None), (4, "..."), (5, "solo"), (None, "gone away"), (6, " ".join(["again"] * 15)), (7, "x " * 3 + long[:40])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "q " + long[10:90] + " q", 1), (1, "q " + long[10:90] + " q", 1), (2, None, 2), (3, "", 3), (4, "ALPHA, beta! solo gone away", 4), (None, "again " * 14, 5), (6, ("z " * 50_000) + long, 6), (7, "ällo " + long[:60], 7)],
        "doc_id long, text string, n_words int",
    )
    both_ways(docs, bench)
    both_ways(docs.limit(0), bench)
    both_ways(docs, bench.limit(0))
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.n_words for r in kept.collect()) == [2, 3, 6]


def test_winnowing_guarantee():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(9, 60))
        h = rng.integers(0, 6, n).astype(np.uint64)
        kept = D.winnow(h, np.zeros(n, np.int64))
        for k in range(n - 8):
            low = h[k : k + 9]
            assert k + 8 - int(np.argmin(low[::-1])) in kept


def test_null_item_ids_hit(spark):
    bench = spark.createDataFrame([(None, "one two three"), (None, "three four"), (8, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "One two three four"), (2, "three four five")], "doc_id long, text string")
    want = both_ways(docs, bench)
    assert [r[1:4] for r in want] == [(4, 4, 2), (3, 2, 1)]


def test_stock_phrases_join_nothing(spark):
    """A phrase of five words in every document and item, beside one document that holds an item."""
    stock = "as we all know well"
    items = [(i, " ".join(f"i{i}a{k}" for k in range(9)) + f" {stock} " + " ".join(f"i{i}b{k}" for k in range(9))) for i in range(1000)]
    docs = [(i, f"d{i} x{i} {stock} y{i} z{i}") for i in range(3000)] + [(5000, "so " + items[7][1] + " end")]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    keys = lambda df, key, items: D.fingerprints(df, key, (), items, True).selectExpr("explode(marks) m")
    assert keys(docs, "doc_id", False).join(keys(bench, "item_id", True), "m").count() < 100
    got = D.contamination(docs, bench, broadcast_rows=0).where("n_hit > 0").collect()
    assert [(r.doc_id, r.n_hit, r.item_ids) for r in got] == [(5000, 23, ["7"])]
