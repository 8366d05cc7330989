import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ratewright.llm import quality
from ratewright.llm.common import read

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_documents=10, max_share=0.1, max_loss=0.5, max_documents=1000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    normal = lambda line: " ".join(W.findall(line.translate(lower)))
    by_host = defaultdict(list)
    for n, (i, text, host) in enumerate(rows):  # of each document its different lines
        by_host[host].append((("row", n) if i is None else i, text or ""))
    documents = {h: {i: {normal(y) for j, t in ts if j == i for y in t.split("\n")} - {""} for i in {i for i, _ in ts}} for h, ts in by_host.items()}
    counts = {h: Counter(x for own in ds.values() for x in own) for h, ds in documents.items()}
    out = {}
    for i, text, host in rows:
        text = text or ""
        words = W.findall(text)
        lines = [x for x in text.split("\n") if W.search(x)]
        grams = Counter(zip(words, words[1:], words[2:]))
        hit = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        bad = [x for x in lines if counts[host][normal(x)] > min(max_documents, max(min_documents, max_share * len(documents[host])))]
        removed = sum(len(W.findall(x)) for x in bad)
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        out[i, text] = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed, len(bad), removed, not failed and removed <= max_loss * len(words))
    return out


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def verdicts(docs, **how):
    """What judge finds, by key and text."""
    texts = {(r.doc_id, r.text, r.source): None for r in docs.collect()}
    assert len({k[0] for k in texts}) == len(texts)
    return {(r.doc_id, next(t or "" for i, t, _ in texts if i == r.doc_id)): tuple(r)[1:] for r in quality.judge(docs, **how).collect()}


def test_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    for how in ({"max_share": 0.1, "min_documents": 2}, {"max_share": 0.03, "min_documents": 2}, {"max_share": 0.03, "min_documents": 2, "broadcast_lines": 0}, {"max_documents": 1}):
        want = brute(rows_of(docs), **{k: v for k, v in how.items() if k != "broadcast_lines"})
        assert verdicts(docs, **how) == want
        assert any(x[6] for x in want.values())


def test_documents_not_rows_are_counted(spark):
    body = " ".join(f"w{k}" for k in range(60))
    line = "a line of three documents"
    rows = [(i % 3, f"{line}\n{body} {i % 3}", "h") for i in range(12)] + [(None, f"without a key\n{body} {i}", "h") for i in range(11)] + [(50, f"own {i}\nof one key\n{body}", "h") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = brute(rows)
    for limit in (500_000, 0):
        got = sorted((str(r.doc_id), r.n_words, r.removed_lines, r.kept) for r in quality.judge(docs, broadcast_lines=limit).collect())
        assert got == sorted((str(i), *(want[i, t][k] for k in (0, 6, 8))) for i, t, _ in rows)
    assert {i: want[i, t][6] for i, t, _ in rows} == {0: 0, 1: 0, 2: 0, None: 1, 50: 0}


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, None, None, "x"), (2, "", "a", "x"), (3, long, None, None), (3, long, None, None), (None, long + "\n\nÀ b\r\nÀ b\r", "a", "y"), (5, "\n \n", "a", "y")],
        "doc_id long, text string, source string, kept string",
    )
    got = sorted((tuple(r) for r in quality.judge(docs).collect()), key=str)
    assert len(got) == 6
    assert sum(r[-1] for r in got) == 3
    [r] = [r for r in got if r[0] is None]
    assert r[1:6] == (64, sum(len(f"w{i}") for i in range(60)) + 4, 0, 1, 0)
    kept = quality.clean(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert quality.judge(docs.limit(0)).count() == 0 and quality.clean(docs.limit(0)).count() == 0


def test_clean_removes_lines(spark):
    body = lambda i: " ".join(f"d{i}w{k}" for k in range(55))
    docs = spark.createDataFrame([(i, f"Menu  home\n{body(i)}\nmenu HOME", "h") for i in range(12)] + [(99, "menu home\n" + body(99), "other")], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert got == {i: f"{body(i)}\n" for i in range(12)} | {99: "menu home\n" + body(99)}
    assert quality.judge(docs, max_loss=0.01).where(~F.col("kept")).count() == 12
