"""Findings: failing checks of rows, rolled up to one row per code with its first message, and from there to dimensions and letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line

LOCAL_DIMENSIONS = ["conformance", "completeness", "interpretability", "freshness"]
ALL_DIMENSIONS = ["retrievability", *LOCAL_DIMENSIONS]


def check(condition: Column, code: str, dimension: str, severity: str, message: str | Column) -> Column:
    """A struct where the condition holds, else null. For :func:`failing`."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(dimension).alias("dimension"), F.lit(severity).alias("severity"), text.alias("message")))


def failing(df: DataFrame, checks: list[Column], *keep: str) -> DataFrame:
    """One row per failing check of each row: all checks are one array expression of a single pass."""
    return df.select(*keep, F.posexplode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("rule", "found")).select(*keep, "rule", "found.*")


def rollup(found: DataFrame, *file_keys: str, position: list[str], occurrences: str | None = None) -> DataFrame:
    """One row per code: how often, and the message, dimension and severity of its first emission by ``position``."""
    first = F.min_by(F.struct("dimension", "severity", "message"), F.struct(*position))
    n = F.sum(occurrences) if occurrences else F.count("*")
    out = found.groupBy(*file_keys, "code").agg(first.alias("first"), n.alias("occurrences"))
    return out.select(*file_keys, "code", "first.dimension", "first.severity", "first.message", "occurrences")


def dimension_status(files: DataFrame, found: DataFrame, key: str, scan_completed: str, items: str) -> DataFrame:
    """A status for each file and local dimension. files: the key, whether the scan completed, how many items it saw."""
    per = found.groupBy(key, "dimension").agg(F.sum((F.col("severity") == "ERROR").cast("bigint")).alias("errors"), F.sum((F.col("severity") == "WARNING").cast("bigint")).alias("warnings"), F.count("*").alias("n"))
    every = files.select(key, scan_completed, items, F.explode(F.array(*map(F.lit, LOCAL_DIMENSIONS))).alias("dimension"))
    met = every.join(per, [key, "dimension"], "left")
    unseen = (~F.col(scan_completed) & F.col("dimension").isin("completeness", "interpretability")) | ((F.col(items) == 0) & (F.col("dimension") == "interpretability"))
    status = F.when(unseen, "NOT_ASSESSED").when(F.col("n") > 0, "FINDINGS").otherwise("OBSERVED")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return met.select(key, "dimension", status.alias("status"), count("errors"), count("warnings"))


# What each fetch status says about retrievability, and how a refused redirect is told.
OBSERVED = ["fetched", "not_modified"]
FINDINGS = ["http_error", "network_error", "content_error"]
UNSAFE_REDIRECT = "unsafe redirect target:"
BARRIER_CODES = [401, 403]


def retrievability(status: Column, http_status: Column, attempts: Column | None = None, error: Column | None = None, inspected: Column | None = None, problems: Column | None = None) -> Column:
    """A struct of status and finding code: the two codes tell a barrier to automation from another failure.

    A success counts as observed if it was ``inspected`` without ``problems`` (where these are told); an invalid address is the publisher's
    doing if something was asked and redirected where nobody may follow.
    """
    no, yes = F.lit(False), F.lit(True)
    redirected = (status == "invalid_url") & (attempts > 0) & F.coalesce(F.startswith(error, F.lit(UNSAFE_REDIRECT)), no) if attempts is not None and error is not None else no
    failed = status.isin(FINDINGS) | redirected
    seen = status.isin(OBSERVED) & (yes if inspected is None else inspected) & (yes if problems is None else ~problems)
    barrier = (status == "http_error") & http_status.isin(BARRIER_CODES)
    return F.struct(
        F.when(seen, "OBSERVED").when(failed, "FINDINGS").otherwise("NOT_ASSESSED").alias("status"),
        F.when(barrier, "MRF_AUTOMATION_BARRIER_OBSERVED").when(failed, "MRF_DIRECT_DOWNLOAD_FAILED").alias("code"),
    )


def grade(statuses: DataFrame, files: DataFrame, key: str, retrieved: str, scan_completed: str) -> DataFrame:
    """A letter per file, from its dimensions and its retrievability status; worse evidence never gives a better letter."""
    bad = (F.col("errors") > 0) | (F.col("status") == "NOT_ASSESSED")
    per = statuses.groupBy(key).agg(F.sum(bad.cast("bigint")).alias("bad"), F.sum("warnings").alias("warned"))
    letter = (
        F.when(F.col(retrieved) == "FINDINGS", "F")
        .when(F.col(retrieved) == "NOT_ASSESSED", "NOT_GRADED")
        .when(~F.col(scan_completed), "F")
        .when(F.col("bad") == 0, F.when(F.col("warned") == 0, "A").otherwise("B"))
        .when(F.col("bad") == 1, "C")
        .when(F.col("bad") == 2, "D")
        .otherwise("F")
    )
    return files.join(per, key).select(key, letter.alias("grade"))


def grade_distribution(grades: DataFrame, *by: str) -> DataFrame:
    """Letters as columns, zeros included, NOT_GRADED apart."""
    out = grades.groupBy(*by).pivot("grade", ["A", "B", "C", "D", "F", "NOT_GRADED"]).count()
    return out.na.fill(0)


def matrix(found: DataFrame) -> DataFrame:
    """Per code: dimension and severity, total occurrences, and how many files have it; which they are is :func:`matrix_files`."""
    first = F.min(F.struct("dimension", "severity"))
    return found.groupBy("code").agg(first.alias("of"), F.sum("occurrences").alias("occurrences"), F.count("*").alias("files")).select("code", "of.dimension", "of.severity", "occurrences", "files")


def matrix_files(found: DataFrame, file_key: str) -> DataFrame:
    """A row for each code and file, in order: a code may be in any number of files, so they are never one value."""
    return found.select("code", file_key, "occurrences").orderBy("code", file_key)


SAMPLES, SAMPLE_LENGTH = 20, 300


def samples(rows: DataFrame, group: str, order: str, value: str, most: int = SAMPLES, length: int = SAMPLE_LENGTH) -> DataFrame:
    """The group, ``n`` (its exact number of rows) and ``samples``: the values of its first ``most`` rows by ``order``, each on one line of ``length`` characters.

    A window drops later rows in the task that sorts a group, so no list is longer than ``most``.
    """
    k = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = rows.select(group, order, one_line(F.col(value), length).alias("shown_")).withColumn("k_", k).where(F.col("k_") <= most)
    listed = first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k_", "shown_"))), lambda x: x["shown_"]).alias("samples"))
    return rows.groupBy(group).agg(F.count("*").alias("n")).join(listed, group)
