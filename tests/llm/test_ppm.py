import math
import zlib
from collections import Counter, defaultdict

from ratewright.llm import ppm
from ratewright.llm.common import read

LOWER = bytes(range(256)).lower()


def trains(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def brute(rows):
    texts = [(i, b" ".join((t or "").encode().lower().split())) for i, t in rows]
    kids = defaultdict(Counter)
    words = Counter()
    for i, t in texts:
        if trains(i):
            b = b"\xff" * 5 + t + b"\xff"
            for k in range(5, len(b)):
                for size in range(6):
                    kids[b[k - size : k]][b[k]] += 1
            words.update(t.split())
            words["end"] += 1
    n, v = sum(words.values()), len(words)

    def p(context, s):
        out, excluded = 1.0, set()
        for size in range(5, -1, -1):
            here = kids.get(context[len(context) - size :])
            if not here:
                continue
            rest = {k: c for k, c in here.items() if k not in excluded}
            total, kinds = sum(rest.values()), len(rest)
            if s in rest:
                return out * (2 * rest[s] - 1) / (2 * total)
            if kinds:
                out *= kinds / (2 * total)
            excluded |= set(here)
        return out / (256 - len(excluded))

    got = {}
    for r, (i, t) in enumerate(texts):
        b = b"\xff" * 5 + t + b"\xff"
        toks = [*t.split(), "end"]
        score = sum(math.log10(p(b[k - 5 : k], b[k])) for k in range(5, len(b)))
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in toks)
        got[r] = (i, not trains(i), len(toks), sum(words[w] > 0 for w in toks), n, base, score)
    return sorted(got.values(), key=str)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9), (a, b)


def test_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents").where("doc_id < 80")
    got = sorted((tuple(r)[:7] for r in ppm.score(docs, block_bytes=20_000).collect()), key=lambda r: r[0])
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=lambda r: r[0])
    close(got, want)
    assert {r[1] for r in got} == {True, False}


def test_held_out_beats_the_base(spark, sf):
    r = ppm.score(read(spark, f"{sf}/../sf0.1", "documents")).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert r.s > r.b


def test_edges(spark):
    rows = [(1, "Abc abd ABC"), (2, None), (3, ""), (4, "ümläut\tabc \n x"), (5, "abc " * 3000), (6, "zzz unseen Zebra"), (7, "abc"), (8, "abd abx"), (9, "abc"), (9, "abc"), (None, "abc q")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, train boolean")
    order = lambda x: sorted(x, key=lambda r: (str(r[0]), r[6]))
    close(order(tuple(r)[:7] for r in ppm.score(docs).collect()), order(brute(rows)))
    held = docs.where("doc_id in (2, 4, 6)").limit(3)
    only = [r for r in held.collect() if not trains(r.doc_id)]
    if only:
        none = held.where(f"doc_id in ({','.join(str(r.doc_id) for r in only)})")
        close(order(tuple(r)[:7] for r in ppm.score(none).collect()), order(brute([(r.doc_id, r.text) for r in only])))
    assert ppm.score(docs.limit(0)).count() == 0
