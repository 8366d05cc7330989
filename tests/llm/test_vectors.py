import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.llm import negatives, topk
from ratewright.llm import vectors as V
from ratewright.llm.common import read

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, tile string, low int"


def whole(rows):
    """(id, label, integers) of the rows that take part."""
    hold = lambda x: math.floor(max(-V.HELD, min(V.HELD, 256 * x)))
    return [(i, label, [hold(x) for x in v]) for i, v, label, *_ in rows if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def order(x):
    return -x[1], x[0] is None, x[0] or 0


def brute_top(rows, queries, k=5):
    rows = whole([(i, v, 0) for i, v, *_ in rows])
    out = []
    for q, _, a in rows:
        if q is not None and queries(q):
            near = sorted(((i, dot(a, v)) for i, _, v in rows if i is None or i != q), key=order)
            out += [(q, n + 1, i, s) for n, (i, s) in enumerate(near[:k])]
    return sorted(out, key=str)


def brute_negatives(rows, anchors, positives=5, count=3):
    rows, out = whole(rows), []
    for q, label, a in rows:
        if q is None or not anchors(q):
            continue
        rest = [(i, dot(a, v), other) for i, other, v in rows if i is None or i != q]
        for p, s, _ in sorted((x for x in rest if x[2] == label), key=order)[:positives]:
            found = sorted((x for x in rest if x[2] != label and 50 * s <= 100 * x[1] <= 95 * s), key=order)
            out += [(q, p, n + 1, i, s, t) for n, (i, t, _) in enumerate(found[:count])]
    return sorted(out, key=str)


def got_top(df, queries, **how):
    return sorted(map(tuple, topk.search(df, queries, **how).collect()), key=str)


def got_negatives(df, anchors, **how):
    return sorted(map(tuple, negatives.mine(df, anchors, F.col("label"), **how).collect()), key=str)


def edges():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 11)], int(rng.integers(0, 3)), 1, "x", 2) for i in range(120)]
    rows += [(i, [0.25] * 11, i % 3, 1, "x", 2) for i in range(200, 260)]  # one vector many times
    rows += [(7, rows[7][1], 1, 0, "", 0), (7, rows[7][1], 1, 0, "", 0), (20, rows[20][1], rows[20][2], 0, "", 0), (20, [0.5] * 11, 0, 0, "", 0)]
    rows += [(None, [0.25] * 11, 1, None, None, None), (None, [0.2] * 11, 0, None, None, None)]
    rows += [(300, None, 1, 0, "", 0), (310, [0.1, None], 1, 0, "", 0), (320, [float("nan")] * 11, 1, 0, "", 0), (330, [float("inf")] * 11, 1, 0, "", 0), (340, [], 1, 0, "", 0), (350, [0.3, -0.2], 2, 0, "", 0), (360, [-0.001] * 11, None, 0, "", 0)]
    rows += [(400, [1e30, -1e30, 5000.0], 1, 0, "", 0), (410, [float(x) for x in rng.normal(0, 900, 19)], 2, 0, "", 0)]
    return rows


@pytest.mark.parametrize("tile", [(7, 13), (256, 2048)])
def test_against_brute_force(spark, tile):
    rows = edges()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ten = lambda i: i % 10 == 0
    assert got_top(df, F.col("vec_id") % 10 == 0, bins=100 if tile[0] == 7 else 1024, tile=tile) == brute_top(rows, ten)
    want = brute_negatives(rows, ten)
    assert got_negatives(df, F.col("vec_id") % 10 == 0, tile=tile) == want and len(want) > 50


def test_few_and_none(spark):
    df = spark.createDataFrame(edges(), SCHEMA)
    assert topk.search(df.limit(0), F.lit(True)).count() == negatives.mine(df.limit(0), F.lit(True), F.col("label")).count() == 0
    assert topk.search(df, F.lit(False)).count() == negatives.mine(df, F.lit(False), F.col("label")).count() == 0
    rows = edges()[:4]
    few = spark.createDataFrame(rows, SCHEMA)
    assert got_top(few, F.lit(True)) == brute_top(rows, lambda i: True)
    assert topk.search(few.limit(1), F.lit(True)).count() == 0


def test_tables(spark, sf):
    df = read(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert got_top(df, F.col("vec_id") % 20 == 0, k=9) == brute_top(rows, lambda i: i % 20 == 0, 9)
    assert got_negatives(df, F.col("vec_id") % 20 == 0) == brute_negatives(rows, lambda i: i % 20 == 0)


def test_lookups_are_inner_products():
    rng = np.random.default_rng(1)
    for low, high, dims in ((-3, 4, 8), (0, 1, 5), (-128, 127, 64), (-(1 << 20), 1 << 20, 17), (-1, 0, 3)):
        a, c = rng.integers(low, high + 1, (9, dims)), rng.integers(low, high + 1, (30, dims))
        kind = np.int64
        tables = object.__new__(negatives.Tables)
        groups = -(-dims // 8)
        wide = np.pad(a, ((0, 0), (0, 8 * groups - dims))).T.reshape(groups, 8, 9)
        tables.kind, tables.sums = kind, [negatives.subset_sums(x, kind) for x in wide]
        assert (tables.scores(V.planes(c.astype(np.int32), int(c.min()), int(c.max()))) == c @ a.T).all()
