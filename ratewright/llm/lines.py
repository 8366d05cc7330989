"""Line dedup by distinct-site spread, with DataFrame functions only.

A line's normal form is lower case with runs of white space as one space; lines without a word are left alone. For each line
hash (64 bits) a HyperLogLog sketch of its sites is built in the map tasks and merged by aggregation, so a line of any
frequency sends one small sketch from each task. A line is cross-site boilerplate if ``min_sites`` different sites have it: lines whose estimate is
further from that than the sketch's error are settled by it, the others get an exact distinct count.

Boilerplate lines are removed, whatever they make up of a document. Lines are told apart by ``xxhash64``, which is no defence against made-up collisions.

Up to ``LITERAL_LINES`` boilerplate lines are put into the plan of the last pass as constants, and no text is shuffled; beyond that, the hashes
of each text are joined with them and the texts with what was found.

Defined cases: a null text stays null and has no lines; null sites are one site of their own; repeated rows each come back;
an empty table gives an empty result; other columns are kept by :func:`dedup`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

MIN_SITES = 10
#: Sketches of 2**10 registers: a standard error of 3.3 %.
LOG_REGISTERS, ERROR = 10, 0.033
LITERAL_LINES, BUCKETS = 2000, 256
#: Near-threshold lines (8 bytes each) that are broadcast at most.
BROADCAST_LINES = 500_000


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x09-\x0D ]+", " "))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def site_pairs(docs: DataFrame, site: str = "source") -> DataFrame:
    """line (hash) and site (hash), once for each document."""
    forms = F.array_distinct(F.transform(_lines(F.col("text")), normal))
    rows = docs.select(F.xxhash64(F.lit("site"), F.col(site)).alias("site"), F.explode(forms).alias("form"))
    return rows.where("form <> ''").select(F.xxhash64("form").alias("line"), "site")


def boilerplate(pairs: DataFrame, min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The hashes of lines that ``min_sites`` sites or more have."""
    spread = pairs.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites"))
    margin = max(1.0, 4 * ERROR * min_sites)
    spread = cut(spread.where(F.col("sites") >= min_sites - margin))
    sure = spread.where(F.col("sites") > min_sites + margin).select("line")
    near = spread.where(F.col("sites") <= min_sites + margin).select("line")
    if near.limit(broadcast_lines + 1).count() <= broadcast_lines:
        near = F.broadcast(near)
    # the rows of a very frequent line are dealt out by its sites before any task counts them
    sites = pairs.join(near, "line", "left_semi").repartition("line", "site").distinct()
    exact = sites.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line")
    return sure.unionByName(exact)


def dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, literal_lines: int = LITERAL_LINES) -> DataFrame:
    """All documents and their columns, then ``line_report``: a struct of n_lines, n_boilerplate and n_removed."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.col(names["text"])
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    pairs = cut(site_pairs(docs.select(F.col("text"), F.col(f"`{site}`").alias("site_name")), "site_name"))
    bad = boilerplate(pairs, min_sites)
    found = small(bad, literal_lines)
    key = F.xxhash64(text)
    if found is None:
        # what a text loses depends on the text alone, so copies of it are looked up once
        texts = rows.where(text.isNotNull()).select(key.alias("text_key"), F.explode(F.array_distinct(F.transform(_lines(text), lambda x: F.xxhash64(normal(x))))).alias("line"))
        lists = texts.join(bad, "line").groupBy("text_key").agg(F.collect_set("line").alias("gone"))
        rows = rows.withColumn("text_key", key).join(lists, "text_key", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<bigint>")))
        is_bad = lambda form: F.array_contains(F.col("gone"), F.xxhash64(form))
    else:
        # constants in BUCKETS lists by their hash, so that a line is compared with a few of them only
        lists: list[list[int]] = [[] for _ in range(BUCKETS)]
        for r in found:
            lists[r.line % BUCKETS].append(r.line)
        constants = F.array(*[F.lit(x) if x else F.array().cast("array<bigint>") for x in lists])
        is_bad = lambda form: F.array_contains(F.element_at(constants, (F.pmod(F.xxhash64(form), F.lit(BUCKETS)) + 1).cast("int")), F.xxhash64(form))

    def one(x: Column) -> Column:
        form = x["form"]
        return F.struct(x["line"].alias("line"), ((form != "") & is_bad(form)).alias("bad"))

    # the normal form first, on its own: a function of a list's elements computes what it uses twice twice
    rows = rows.withColumn("forms", F.transform(_lines(text), lambda x: F.struct(x.alias("line"), normal(x).alias("form"))))
    judged = rows.withColumn("parts", F.transform("forms", one))
    judged = judged.withColumn("n_bad", F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + F.when(p.bad, 1).otherwise(0)))
    removes = F.col("n_bad") > 0
    left = F.array_join(F.transform(F.filter("parts", lambda p: ~p.bad), lambda p: p.line), "\n")
    zero = F.lit(0).cast("bigint")
    report = F.struct(F.when(text.isNull(), zero).otherwise(F.size("parts").cast("bigint")).alias("n_lines"), F.coalesce("n_bad", zero).alias("n_boilerplate"), F.when(removes, F.col("n_bad")).otherwise(zero).alias("n_removed"))
    return judged.select(*[(F.when(removes, left).otherwise(text) if c == "text" else F.col(n)).alias(c) for c, n in names.items()], report.alias("line_report"))
