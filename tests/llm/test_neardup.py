import random
from collections import Counter, defaultdict

import numpy as np

from ratewright.llm import neardup as N
from ratewright.llm.common import read
from ratewright.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def union_find(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


def idf(rows):
    """The inverse document frequency over all rows, exact."""
    df = Counter(x for _, t in rows for x in shingles(t))
    return {x: 1 + np.log((1 + len(rows)) / (1 + n)) for x, n in df.items()}


def brute(rows, least=0.8):
    """Classes by the weighted similarity of all pairs that share a shingle."""
    weight = idf(rows)
    texts = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        texts[t or ""].append(i)
    links = [(v[0], x) for v in texts.values() for x in v[1:]]
    of, index, shared = [v[0] for v in texts.values()], defaultdict(list), Counter()
    counts = {i: shingles(rows[i][1]) for i in of}
    total = {i: sum(n * weight[x] for x, n in c.items()) for i, c in counts.items()}
    for i in of:
        for x, n in counts[i].items():
            for j in index[x]:
                shared[j, i] += min(n, counts[j][x]) * weight[x]
            index[x].append(i)
    links += [(a, b) for (a, b), n in shared.items() if n / (total[a] + total[b] - n) >= least]
    return union_find(len(rows), links), links


def test_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in N.classes(read(spark, sf, "documents")).collect()}
    assert len(got) == len(rows)
    want, links = brute(rows)
    assert len(links) > 30
    together = sum(got[rows[a][0]].class_id == got[rows[b][0]].class_id for a, b in links)
    assert together >= 0.99 * len(links)  # of all linked pairs, near and exact
    # and no class holds what nothing near 0.8 links (the sketch of frequencies is off by little)
    loose, _ = brute(rows, 0.78)
    label = {i: loose[k] for k, (i, _) in enumerate(rows)}
    assert all(label[i] == label[r.class_id] for i, r in got.items())
    sizes = Counter(r.class_id for r in got.values())
    assert all(r.class_size == sizes[r.class_id] and r.class_id <= i for i, r in got.items())


def test_edges_and_chains(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    chain, cur = [], list(base)
    for k in range(25):  # each is near the next, the ends are far apart
        chain.append(" ".join(cur))
        cur[6 * k : 6 * k + 3] = [f"n{k}a", f"n{k}b", f"n{k}c"]
    rows = [(100 + k, t) for k, t in enumerate(chain)] + [(1, None), (2, ""), (3, "two words"), (4, "TWO words"), (5, "other words"), (None, chain[0]), (6, chain[3]), (6, chain[3]), (7, "x " * 30_000)]
    rows += [(1000 + i, "hot copy of a text with enough words") for i in range(200)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, label int")
    got = N.classes(docs).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.class_id for r in got}
    assert {of[100 + k] for k in range(25)} == {6} and of[None] == 6 and of[2] == 1 and of[4] == 3 and of[5] == 5 and of[1100] == 1000
    kept = N.dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 1000]
    assert N.classes(docs.limit(0)).count() == 0 and N.dedup(docs.limit(0)).count() == 0


def test_all_null_keys(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert sorted(r.text for r in N.dedup(docs).collect()) == ["a b c", "d e f"]


def test_samples_match_as_often_as_texts_are_similar():
    rng = random.Random(9)
    import pyarrow as pa

    from ratewright.llm import kernels as K

    hits = n = 0
    for _ in range(60):
        words = [f"w{rng.randrange(10**7)}" for _ in range(204)]
        other = [f"w{rng.randrange(10**7)}" for _ in range(20)] + words[20:]
        s = N.Shingles(*K.raw(pa.array([" ".join(words), " ".join(other)])))
        keys = N._bands(s, s.count.astype(float), 2)
        hits += int((keys[0] == keys[1]).sum())
        n += N.BANDS
    # 180 of 220 shingles are shared; a band is three samples
    assert abs(hits / n - (180 / 220) ** 3) < 0.06


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(1000, x) for x in range(900, 950)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find(1001, links)
    least = {}
    for x in sorted(got):
        least.setdefault(want[x], x)
    assert got == {x: least[want[x]] for x in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}


def test_weights_fall_with_frequency(spark, sf):
    w = N.weights(read(spark, sf, "documents"))
    docs = read(spark, sf, "documents")
    want = idf([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert w.shape == (N.SLOTS,) and w.min() >= 1 and abs(w.max() - 1 - np.log(1 + docs.count())) < 1e-5 and abs(np.median(w[w < w.max()]) - np.median(list(want.values()))) < 1


def _bucket(n, pair=(0, -1)):
    """A bucket of ``n`` different texts, one class but for the two of ``pair``, which have the same places and share two bands with each other."""
    rng = np.random.default_rng(3)
    places = rng.integers(0, 255, (n, N.PLACES), dtype=np.uint8)
    places[pair[1]] = places[pair[0]]
    bands = rng.integers(1 << 40, 1 << 60, (n, N.BANDS))
    bands[:, 0] = 7
    bands[pair[1], 3] = bands[pair[0], 3] = 9
    label = np.zeros(n, int)
    label[list(pair)] = 1, 2
    return [(7, k, bytes(places[k]), [int(x) for x in bands[k]], int(label[k])) for k in range(n)]


def test_large_buckets_are_compared_whole(spark):
    schema = "key long, rep long, places binary, bands array<long>, label long"
    rows = _bucket(1300)
    hot = spark.createDataFrame(rows, schema)
    found = lambda df, run: {(r.a, r.b) for r in N._dealt_blocks(df, run).mapInArrow(lambda b: N._candidates(b, 0.8, N._between), "a long, b long").collect()}
    assert found(hot, 100) == found(hot, 5000) == {(0, 1299)}
    # every pair between classes meets once, and blocks stay small
    many = spark.createDataFrame([(*r[:4], r[1] % 5 if r[1] % 3 else 0) for r in rows[:60]], schema)
    met = defaultdict(list)
    for r in N._dealt_blocks(many, 10).collect():
        met[r.i, r.j].append(r)
    assert max(map(len, met.values())) < 30
    pairs = Counter()
    for v in met.values():
        two = any(r.side for r in v)
        pairs.update(tuple(sorted((a.rep, b.rep))) for k, a in enumerate(v) for b in v[:k] if a.label != b.label and (not two or a.side != b.side))
    label = {r[1]: r[1] % 5 if r[1] % 3 else 0 for r in rows[:60]}
    assert pairs == Counter((a, b) for a in label for b in label if a < b and label[a] != label[b])


def test_repeated_lines_link_by_weight(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**7)}"
    line = " ".join(word() for _ in range(30))
    rows = [(k, "\n".join([line] * 20 + [" ".join(word() for _ in range(40))])) for k in range(6)]
    a, b = (shingles(t) for _, t in rows[:2])
    assert len(set(a) & set(b)) / len(set(a) | set(b)) < 0.5 and (a & b).total() / (a | b).total() > 0.84
    rows += [(10 + k, " ".join(word() for _ in range(100))) for k in range(20)]
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 6 else i for i, _ in rows}


def test_places_never_understate_the_similarity():
    import pyarrow as pa

    from ratewright.llm import kernels as K

    rng = random.Random(5)
    words = [f"w{rng.randrange(10**7)}" for _ in range(400)]
    texts = [" ".join(words[:60] * 10 + words[60:200]), " ".join(words[:60] * 9 + words[200:300]), " ".join(words), " ".join(words[30:]), "a " * 100_000 + " ".join(words[:50]), "a " * 101_000, "b", " ".join(words[:300] + ["x"] * 9)]
    s = N.Shingles(*K.raw(pa.array(texts)))
    weight = s.count * (1 + (K.mix(s.hash) >> np.uint64(54)).astype(float) / 100)
    places = np.frombuffer(b"".join(N._places(s, weight, len(texts))), np.uint8).reshape(-1, N.PLACES)
    of = [dict(zip(s.hash[s.text == k].tolist(), weight[s.text == k], strict=True)) for k in range(len(texts))]
    for j, y in enumerate(of):
        bounds = N._bounds(places, places[j])
        for i, x in enumerate(of):
            true = sum(min(w, y.get(h, 0)) for h, w in x.items()) / sum(max(x.get(h, 0), y.get(h, 0)) for h in {*x, *y})
            assert bounds[i] >= N._least(true)
            assert i == j or true > 0.6 or bounds[i] < 0.8


def test_split_buckets_give_the_same_classes(spark):
    """A template with many near copies, in blocks of any size: every class is the brute-force one."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 8])):
            words[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute(rows)
    parts = {frozenset(k for k in range(150) if want[k] == x) for x in want}
    for near, run in ((8, 20), (64, 500)):
        got = defaultdict(set)
        for r in N.classes(docs, near=near, run=run).collect():
            got[r.class_id].add(r.doc_id)
        assert set(map(frozenset, got.values())) == parts
