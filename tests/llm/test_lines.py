import re
from collections import defaultdict

import duckdb

from ratewright.llm import lines, queries
from ratewright.llm.common import read


def normal(x):
    return re.sub(r"[\x09-\x0D ]+", " ", x.lower()).strip(" ")


def brute(rows, min_sites=10):
    sites = defaultdict(set)
    for _, text, site in rows:
        for x in (text or "").split("\n"):
            sites[normal(x)].add(site)
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0, 0, 0))
            continue
        parts = text.split("\n")
        bad = [bool(normal(x)) and len(sites[normal(x)]) >= min_sites for x in parts]
        gone = any(bad)
        out.append((i, "\n".join(x for x, b in zip(parts, bad) if not b) if gone else text, len(parts), sum(bad), sum(bad) * gone))
    return sorted(out, key=str)


def got(docs, **how):
    return sorted(((r.doc_id, r.text, *r.line_report) for r in lines.dedup(docs, **how).collect()), key=str)


def rows_of(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def test_tables_both_ways(spark, sf):
    docs = read(spark, sf, "documents")
    for n in (3, 10):
        want = brute(rows_of(docs), n)
        assert got(docs, min_sites=n) == want and got(docs, min_sites=n, literal_lines=0) == want
        assert sum(r[4] for r in want) > 0


def test_near_lines_joined_or_broadcast(spark, sf):
    pairs = lines.site_pairs(read(spark, sf, "documents"))
    found = [sorted(r.line for r in lines.boilerplate(pairs, 5, limit).collect()) for limit in (0, 10**6)]
    assert found[0] == found[1] != []


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op7_line_dedup"])
    names = [d[0] for d in want.description]
    df = queries.op7_line_dedup(spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


def test_edges(spark):
    body = "one two three four five six"
    rows = [(i, f"{body} {i}\nHome  PAGE\t\n", f"s{i}", i) for i in range(12)] + [(i, "a whole copied text\nof two lines", f"s{i}", i) for i in range(20, 35)]
    rows += [(50, None, "s1", 0), (51, "", None, 0), (52, "home page", None, 0), (53, "\n\n", "s2", 0), (None, "Home page\n" + body, "s9", 0), (None, "Home page\n" + body, "s9", 0), (60, "x y\n" * 50_000 + "home page", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, line long")
    want = brute(rows_of(docs))
    for limit in (2000, 0):
        assert got(docs, literal_lines=limit) == want
    assert lines.dedup(docs).columns == [*docs.columns, "line_report"]
    assert lines.dedup(docs.limit(0)).count() == 0


def test_no_python(spark, sf):
    plan = lines.dedup(read(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
