from collections import Counter, defaultdict

import corpus_pipeline
from ratewright.llm.common import read, stored
from tests.llm import test_decontaminate, test_lines, test_neardup, test_packing, test_quality


def test_stages_against_brute_force(spark, sf):
    """Each stage on the rows its predecessor kept."""
    docs = read(spark, sf, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    rows_of = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = rows_of(docs)
        out = stored(stage(spark, docs, sf), f"t{k}")
        if name != "best_fit_packing":
            assert out.columns == columns
            got = {r.doc_id: r for r in out.collect()}
            assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source) for i, r in got.items())
            kept = {i: r.text for i, r in got.items()}
        if name == "quality_rules":
            assert set(kept) == {i for (i, _), v in test_quality.brute(rows).items() if v[-1]}
        elif name == "line_dedup":
            assert kept == {i: t for i, t, *_ in test_lines.brute(rows)}
        elif name == "near_dedup":
            label, _ = test_neardup.brute([(i, t) for i, t, _ in rows])
            loose, _ = test_neardup.brute([(i, t) for i, t, _ in rows], 0.78)
            by, wide = defaultdict(list), defaultdict(list)
            for (i, _, _), a, b in zip(rows, label, loose, strict=True):
                by[a].append(i), wide[b].append(i)
            assert all(sum(i in kept for i in v) <= 1 for v in by.values())
            assert all(any(i in kept for i in v) for v in wide.values())
        elif name == "benchmark_decontamination":
            assert set(kept) == {r[0] for r in test_decontaminate.brute([(i, t) for i, t, _ in rows], items) if not r[-1]}
        else:
            pieces = Counter(r.doc_id for r in out.collect())
            assert set(pieces) == {i for i, _, _ in rows}
            test_packing.check(spark, docs)
        docs = out
    got, want = (Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect()) for df in (corpus_pipeline.run(spark, sf), docs))
    assert got == want
    assert 0 < len({i for i, *_ in got}) < len(before)


def test_empty_and_nulls(spark, sf):
    docs = read(spark, sf, "documents").limit(0)
    rows = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "kept " * 10 + " ".join(f"w{k}" for k in range(60)), "en", None, 1), (2, "kept " * 10 + " ".join(f"w{k}" for k in range(60)), "en", None, 1)], docs.schema)
    for table, n in ((docs, 0), (rows, 1)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, sf)
        assert table.count() == n


def test_clashing_columns_and_long_texts(spark, sf):
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, own(i, 60 if i else 60_000), "en", f"s{i}", 1, True, "x", 7, [1]) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, text_key string, id int, lines array<int>"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), f"clash-{name}")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, docs.drop("n_chars").collect())) == sorted((*r[:4], *r[5:]) for r in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in last.collect()} == set(range(6)) and last.where("doc_id = 0").count() > 10
