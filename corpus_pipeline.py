"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and packing, one stage after the other.

Each stage works on all that the one before it kept, and its decisions take effect: documents that the quality rules reject go, and
boilerplate lines go from the others; cross-site lines go; one document of each near-duplicate class stays; contaminated documents
go; what is left is packed into sequences. All but the last return the columns of ``documents``. In every stage repeated rows are judged alike,
further columns pass through whatever their names, texts of any length are taken whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm import decontaminate, lines, neardup, packing, quality
from ratewright.llm.common import read, stored



def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Documents that fail the base rules, null and empty texts among them, and those depleted of their host's frequent lines go; the lines go from the others.

    A null host is a host of its own; a null key is a document of its own, rows of one key are one document when lines are counted, and each row is judged.
    """
    return _counted(quality.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Lines of ten sites or more go; every document stays, one that is nothing but such lines with an empty text, a null text as it is."""
    return _counted(lines.dedup(docs).drop("line_report"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. One row of each class of near-duplicates stays, the one with the least key; equal texts are one class, null texts with empty ones."""
    return neardup.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Contaminated documents go; null and empty texts hold nothing and stay, without benchmark rows all stay."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. A row for each piece of each document's ids and its place in a sequence; a null text is the end id alone, a long one several pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Near-duplicate classes and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; what a stage returns is written and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
