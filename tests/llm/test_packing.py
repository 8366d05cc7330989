import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from ratewright.llm import packing as P
from ratewright.llm.common import read
from ratewright.llm.tokens import public_path


def exact(sizes, capacity):
    """Fewest bins, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b + sizes[k] <= capacity}.values():
            bins[i] += sizes[k]
            go(k + 1, bins)
            bins[i] -= sizes[k]
        bins.append(sizes[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best


def whole(patterns, histogram, capacity):
    used = Counter()
    for pattern, times in patterns:
        assert sum(s * m for s, m in pattern) <= capacity
        for s, m in pattern:
            used[s] += m * times
    assert used == Counter(histogram)
    return sum(t for _, t in patterns)


def test_plan_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        h = dict(Counter(sizes))
        bfd = whole(P.best_fit_decreasing(h, capacity), h, capacity)
        n = whole(P.plan(h, capacity), h, capacity)
        assert n <= bfd and n == exact(sizes, capacity)


def test_search_is_exact_without_limits():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([9, 20, 40])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        h = dict(Counter(sizes))
        found, best = P.search(h, capacity, None, None), exact(sizes, capacity)
        assert whole(found.patterns, h, capacity) == found.sequences == found.at_least == best >= P.lower_bound(h, capacity)
        assert P.search(h, capacity).at_least <= best


def test_planted_packings():
    """Sequences cut at random into four or five pieces are put together again; of three pieces, one sequence more at most, and the gap shows."""
    for sequences, pieces, more in ((30, 4, 0), (60, 5, 0), (60, 3, 1)):
        for seed in range(4):
            rng, sizes = random.Random(seed), []
            for _ in range(sequences):
                cuts = [0, *sorted(rng.sample(range(1, 2048), pieces - 1)), 2048]
                sizes += [b - a for a, b in zip(cuts, cuts[1:])]
            h = dict(Counter(sizes))
            found = P.search(h, 2048)
            assert whole(found.patterns, h, 2048) == found.sequences <= sequences + more and found.at_least == sequences


def test_plan_at_scale():
    rng = np.random.default_rng(1)
    sizes = np.minimum(2048, rng.lognormal(6, 1.2, 200_000).astype(int) + 1)
    h = {int(k): int(v) for k, v in Counter(sizes.tolist()).items()}
    n = whole(P.plan(h), h, 2048)
    assert n <= max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum())) + 2


def check(spark, docs):
    got = P.pack_documents(docs, with_ids=True).collect()
    library = Tokenizer.from_file(public_path(P.TOKENIZER))
    rows = defaultdict(list)
    for r in got:
        rows[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    want = Counter()
    for d in docs.collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        want.update((d.doc_id, k, s, tuple(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r.n_sequences for r in got} <= {len(by)} and all(r.least_sequences <= r.n_sequences for r in got)
    return got, by


def test_tables(spark, sf):
    got, by = check(spark, read(spark, sf, "documents"))
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert sum(map(len, (r.ids for r in P.sequences(P.pack_documents(read(spark, sf, "documents"), with_ids=True)).collect()))) == sum(r.length for r in got)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (None, "a b c", 3), (4, "word " * 9000, 4), (5, "日本語 <|endoftext|> x", 5), (6, "same text", 6), (7, "same text", 6)], "doc_id long, text string, length int")
    check(spark, docs)
    assert P.pack_documents(docs.limit(0)).count() == 0
    clash = docs.selectExpr("coalesce(doc_id, -1) as id", "0 as piece", "cast(7 as bigint) as length", "1 as size", "2 as rank", "3 as low", "4 as own", "5 as before", "6 as salt", "7 as n")
    got = P.pack(clash, 20)
    assert got.columns == [*clash.columns, "sequence_id", "offset", "n_sequences", "least_sequences"] and Counter(r.sequence_id for r in got.collect()) == {k: 2 for k in range(docs.count() // 2)}
