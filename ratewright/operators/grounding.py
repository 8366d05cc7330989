"""Grounding: for each record, passages that its findings can be argued from, taken from what the findings cite and nothing else.

A finding's candidates are the passages of the sources that its addresses name, and the statistics of its ranking (number of passages, average length, how
many have a term) are those of its candidates. Sources don't share passages, so each is counted once and a set of sources adds up the
counts of its members: no finding is paired with a passage for the statistics. Findings of one set and the same terms are one
question, which is ranked once, however many records ask it.

Defined cases: addresses match exactly, and of sources with one address the least is meant; a finding without a known address, without terms or whose
candidates hold none of its terms gets nothing; scores are compared as rounded to 9 places, ties go to the smaller passage id; a passage that several findings of a record get
keeps its first place; an address that names no source is listed once for a record, at its first place; null texts hold no terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

EACH, MOST = 3, 16


def unresolved(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """record, position (from 1) and url of the addresses that no source has. citations: record, place (of the finding), position, url."""
    unknown = X.cite_sources(citations, sources).where("source_id is null and url is not null")
    first = unknown.groupBy("record", "url").agg(F.min(F.struct("place", "position")).alias("first"))
    return first.select("record", F.row_number().over(Window.partitionBy("record").orderBy("first", "url")).alias("position"), "url")


def questions(findings: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """record, place, set (of sources), of (its members), question and terms, of each finding with a known source. findings: record, place, query."""
    known = X.cite_sources(citations, sources).where("source_id is not null")
    sets = known.groupBy("record", "place").agg(F.array_sort(F.collect_set("source_id")).alias("of")).withColumn("set", F.sha2(F.to_json("of"), 256))
    terms = findings.select("record", "place", F.array_sort(F.array_distinct(X.tokens(F.col("query")))).alias("terms")).where(F.size("terms") > 0)
    return terms.join(sets, ["record", "place"]).withColumn("question", F.sha2(F.concat("set", F.array_join("terms", " ")), 256))


def rank(asked: DataFrame, passages: DataFrame, each: int = EACH) -> DataFrame:
    """question, passage_id, score and rank: the ``each`` best passages of each question's set. passages: source_id, passage_id, text."""
    asked = asked.select("question", "set", "of", "terms").dropDuplicates(["question"])
    sets = asked.select("set", F.explode("of").alias("source_id")).distinct()
    wanted = asked.select("set", F.explode("terms").alias("term")).distinct().join(sets, "set")
    cut = passages.select("source_id", "passage_id", X.tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    shape = cut.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("length"))
    shape = sets.join(shape, "source_id").groupBy("set").agg(F.sum("n").alias("n"), F.greatest(F.sum("length") / F.sum("n"), F.lit(1.0)).alias("average"))
    # terms that nobody asks of a source go before anything is counted
    tf = cut.select("source_id", "passage_id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    tf = tf.join(wanted.select("source_id", "term").distinct(), ["source_id", "term"], "left_semi").groupBy("source_id", "term", "passage_id", "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("source_id", "term").agg(F.count("*").alias("df"))
    df = wanted.join(df, ["source_id", "term"]).groupBy("set", "term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (X.K1 + 1) / (F.col("tf") + X.K1 * (1 - X.B + X.B * F.col("length") / F.col("average")))
    terms = asked.select("question", "set", F.explode("terms").alias("term")).join(df, ["set", "term"]).join(shape, "set").join(sets, "set")
    hits = terms.join(tf, ["source_id", "term"]).groupBy("question", "passage_id").agg(F.sum(weight).alias("score")).where("score > 0")
    order = Window.partitionBy("question").orderBy(F.round("score", 9).desc(), "passage_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)


def ground(findings: DataFrame, citations: DataFrame, sources: DataFrame, passages: DataFrame, each: int = EACH, most: int = MOST) -> DataFrame:
    """record, position (from 1), passage_id, place (of the finding that brings it) and rank: the findings' passages in turn, first all first ones, each once, at most ``most``."""
    asked = questions(findings, citations, sources)
    ranked = asked.select("record", "place", "question").join(rank(asked, passages, each), "question")
    return X.interleave(ranked, "place", "passage_id", "rank", most, within="record").select("record", "position", "passage_id", "place", "rank")
