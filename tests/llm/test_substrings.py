import re

import numpy as np

from ratewright.llm import kernels as K
from ratewright.llm import queries
from ratewright.llm import substrings as S
from ratewright.llm.common import read

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = re.compile(r"[.!?][\"')\]}]{0,2}\Z")


def sentences(text, most=12):
    """Ranges of words of each sentence, and the words."""
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
    out, cur = [], []
    for i, w in enumerate(words):
        if cur and (END.search(words[i - 1].group()) or "\n" in text[words[i - 1].end() : w.start()]):
            out.append(cur)
            cur = []
        cur.append(i)
    if cur:
        out.append(cur)
    pieces = []
    for s in out:
        start = 0
        for i in [*content_cuts([words[k].group() for k in s], most), len(s)]:
            pieces += [s[k : min(k + most, i)] for k in range(start, i, most)]
            start = i
    return pieces, words


def content_cuts(words, most):
    """Of a long sentence, the words whose hash (with the next word's) is under those of all within four words."""
    if len(words) <= most:
        return []
    data = [np.frombuffer(w.translate(LOWER).encode(), np.uint8) for w in words]
    h = [int(K.bytes_hashes(d, np.array([0]), np.array([len(d)]))[0]) for d in data]
    joint = [int(K.mix(np.array([(a + (b * 0x9E3779B97F4A7C15 if b is not None else 0)) % 2**64], np.uint64))[0]) for a, b in zip(h, [*h[1:], None])]
    return [i for i in range(4, len(words)) if all(joint[i] < joint[k] for k in range(max(0, i - 4), min(len(words), i + 5)) if k != i)]


def brute(rows, n=3):
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for i, text in docs:
        parts, words = sentences(text)
        low = [w.group().translate(LOWER) for w in words]
        gone = set()
        for k in range(len(parts) - n + 1):
            span = tuple(low[parts[k][0] : parts[k + n - 1][-1] + 1])
            if first.setdefault(span, (i, text, k)) != (i, text, k):
                gone.update(range(k, k + n))
        cut = [(words[p[0]].start(), words[p[-1] + 1].start() if p[-1] + 1 < len(words) else len(text)) for k, p in enumerate(parts) if k in gone]
        rest, at = "", 0
        for a, b in cut:
            rest += text[at:a]
            at = b
        out[i, text] = (rest + text[at:], len(parts), len(gone), sum(len(parts[k]) for k in gone))
    return sorted(((i, *(out[i, t] if t is not None else (None, 0, 0, 0))) for i, t in rows), key=str)


def got(docs):
    return sorted(((r.doc_id, r.text, *r.span_report) for r in S.dedup(docs).collect()), key=str)


def test_tables(spark, sf):
    docs = read(spark, sf, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(docs) == want
    assert sum(r[3] for r in want) > 0


def test_edges(spark):
    passage = "One two three four. Five six seven eight! Nine ten eleven twelve? Thirteen fourteen."
    free = " ".join(f"w{i}" for i in range(60))
    rows = [
        (2, "Own start here. " + passage + " And own end."), (1, "Another text. " + passage), (3, passage.upper() + "\nx"), (4, None), (4, None), (5, ""), (6, "a. b. c. d. a. b. c. d."), (7, free + ". ü é."),
        (8, "ß à. " + free + ". tail"), (9, passage), (9, passage), (None, "(" + passage + ") \"Quoted end.\" next one."), (10, "x. " * 40_000), (11, "same same. " * 30),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, span int")
    want = brute(rows)
    assert got(docs) == want
    assert S.dedup(docs).columns == ["doc_id", "text", "span", "span_report"]
    assert S.dedup(docs.limit(0)).count() == 0


def test_query_finds_short_sentences_and_shifted_copies(spark, tmp_path):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    short = " ".join(f"s{i}." for i in range(155))
    rows = [(0, short), (1, "Other. " + short + " End."), (2, "start " + words("p", 200))]
    rows += [(10 + k, words(f"own{k}x", k) + " " + words("p", 200) + " " + words(f"more{k}x", 40)) for k in range(13)]
    rows += [(30, "y. " * 20), (31, "z. " * 7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[0].text == short and got[2].text == rows[2][1] and len(got) == len(rows)
    assert got[1].removed_words == 155 and got[1].text == "Other. End."
    assert all(170 <= got[10 + k].removed_words <= 200 for k in range(13))
    assert all(f"own{k}x{i}" in got[10 + k].text for k in range(13) for i in range(k))
    assert got[30].text.split() == ["y."] and got[31].text.split() == ["z."]


def test_short_runs_at_the_end_of_texts(spark):
    rows = [(1, "Buy now. Call us. Go home."), (2, "Buy now. Call us. Go home."), (3, "Some words before it. Buy now. Call us. Go home.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)
    assert [r[1].strip() for r in got(docs)] == [rows[0][1], "", "Some words before it."]
    # with a least number of words, runs grow as far as their text goes
    assert [r.text for r in S.dedup(docs, min_words=7).orderBy("doc_id").collect()] == [t for _, t in rows]
