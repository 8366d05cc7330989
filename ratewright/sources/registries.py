"""Registries of one JSON record a line: attempts (fetches and discoveries), checked record by record; assessments are checked by :mod:`..operators.records`.

A record is never trusted for being there: a line that isn't one, or says two different things, has a ``problem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions of attempt records that can be read.
ATTEMPT_VERSIONS = [1, 2]
FETCH, DISCOVERY = "fetch", "discovery"
ATTEMPT = """version int, domain string, kind string, url string, attempted_at string, problems array<string>,
    fetch struct<url:string,attempted_at:string,status:string,http_status:int,attempts:int,final_url:string,content_sha256:string,size_bytes:bigint,error:string>,
    discovery struct<domain:string,entries:array<map<string,string>>,problems:array<string>>"""


class BadRecords(ValueError):
    """Some lines of a registry can't be trusted; the message says why and how many."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``value`` of every line that isn't blank."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")


def _first(*reasons: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for test, why in reversed(reasons):
        out = F.when(F.coalesce(test, F.lit(True)), why).otherwise(out)
    return out


def attempts(lines_: DataFrame) -> DataFrame:
    """lines (``value``) to the columns of ATTEMPT, ``ok`` and ``problem``."""
    r = lines_.withColumn("r", F.from_json("value", ATTEMPT)).select(*lines_.columns, "r.*")
    c = F.col
    found = c("discovery").isNotNull()
    no = lambda test: F.coalesce(test, F.lit(False))
    problem = _first(
        (F.try_parse_json("value").isNull() | c("version").isNull(), "not a record"), (~c("version").isin(ATTEMPT_VERSIONS), "another version"), (c("domain").isNull() | ~no(c("kind").isin(FETCH, DISCOVERY)) | c("url").isNull() | c("fetch.status").isNull(), "a field is missing"),
        (~(c("url").eqNullSafe(c("fetch.url")) & c("attempted_at").eqNullSafe(c("fetch.attempted_at"))), "the fetch is of another attempt"), (found & ~c("discovery.domain").eqNullSafe(c("domain")), "the discovery is of another domain"), ((c("kind") == FETCH) & found, "a fetch with a discovery"),
    )
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) == 0
    usable = ~found | ((F.size("discovery.entries") > 0) & empty("discovery.problems"))
    return r.withColumns({"problem": problem, "ok": no(c("fetch.status").isin("fetched", "not_modified")) & no(usable) & empty("problems")})


def require_good(records: DataFrame) -> DataFrame:
    bad = records.where("problem is not null").groupBy("problem").count().orderBy("problem").collect()  # as many rows as there are reasons
    if bad:
        raise BadRecords("; ".join(f"{r.problem}: {r['count']}" for r in bad))
    return records.drop("problem")
