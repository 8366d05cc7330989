"""Assessments of files: one retrieval each, joined with the inspection of what it brought, if there is one.

``retrievals``: file_id, publisher_id, location_id, requested_url, url, attempted_at (ISO text with a zone), status, http_status, attempts,
error, content_sha256, size_bytes, content_type, problems (array of text). ``inspections``: file_id, source_sha256, source_size,
inspected_as_of, inspected_publisher, scan_completed, items. ``found``: the rolled-up findings of inspections (file_id, code, dimension,
severity, occurrences). Everything is joins and expressions; a file's rows never meet in one place but for its few dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import utc_date
from ..functions.text import media_type, redact_problem, redact_url
from ..functions.canonical import json_digest
from .findings import ALL_DIMENSIONS, LOCAL_DIMENSIONS, OBSERVED, retrievability

# Statuses that aren't the file's doing at all, and the kinds of web pages.
INFRASTRUCTURE = ["cache_error", "cache_miss"]
WEB_PAGES = ["text/html", "application/xhtml+xml"]


class NotComposed(ValueError):
    """Some inspections can't belong to the retrievals they came with; the message says why and how many."""


def compose(retrievals: DataFrame, inspections: DataFrame) -> DataFrame:
    """Retrievals with their inspection's columns, ``as_of``, ``inspected``, the retrievability and ``refusals``, why the two can't be one assessment."""
    c = F.col
    seen = inspections.withColumn("inspected", F.lit(True))
    met = retrievals.join(seen, "file_id", "left").withColumns({"inspected": F.coalesce("inspected", F.lit(False)), "as_of": utc_date(c("attempted_at"))})
    success, problems = c("status").isin(OBSERVED), F.coalesce(F.size("problems"), F.lit(0)) > 0
    unlike = lambda a, b: ~c(a).eqNullSafe(c(b))
    reasons = [
        (~c("url").eqNullSafe(c("requested_url")), "another address was fetched"),
        (c("as_of").isNull(), "the time of the attempt isn't an ISO time with a zone"),
        (c("inspected") & ~success, "only a successful retrieval can have an inspection"),
        (c("inspected") & success & (c("content_sha256").isNull() | c("size_bytes").isNull()), "the retrieval doesn't say what it brought"),
        (c("inspected") & success & c("content_sha256").isNotNull() & unlike("source_sha256", "content_sha256"), "other bytes were inspected"),
        (c("inspected") & success & c("size_bytes").isNotNull() & unlike("source_size", "size_bytes"), "another number of bytes was inspected"),
        (c("inspected") & unlike("inspected_as_of", "as_of"), "the days of inspection and retrieval differ"),
        (c("inspected") & unlike("inspected_publisher", "publisher_id"), "the inspection is of another publisher"),
    ]
    told = retrievability(c("status"), c("http_status"), c("attempts"), c("error"), c("inspected"), problems)
    status, code = told["status"], F.when(told["status"] == "FINDINGS", told["code"])
    return met.withColumns({"retrievability": status, "retrieval_code": code, "note": _note(status), "refusals": F.filter(F.array(*[F.when(test, text) for test, text in reasons]), lambda x: x.isNotNull())})


def _note(status: Column) -> Column:
    """A sentence on the retrieval, for people."""
    c = F.col
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    cause = F.concat_ws("; ", F.when(c("http_status").isNotNull(), text("HTTP ", c("http_status").cast("string"))), redact_problem(c("error")))
    return (
        F.when(status == "OBSERVED", text(F.when(c("status") == "not_modified", "a cached copy was validated at ").otherwise("downloaded at "), c("attempted_at"), ", sha256 ", c("content_sha256")))
        .when(status == "FINDINGS", text(c("status"), " at ", c("attempted_at"), " after ", c("attempts").cast("string"), " attempt(s): ", F.when(cause == "", "nothing usable came").otherwise(cause)))
        .when(c("status").isin(OBSERVED), "the download is reported as good, but its bytes couldn't be verified and inspected here")
        .when(c("status") == "invalid_url", "the address is invalid, and nobody was asked; whose fault that is isn't known")
        .when(c("status") == "too_large", "our own limit on size ended the download")
        .when(c("status") == "tls_verification_failed", "the certificate didn't verify from here, which may be this machine's doing")
        .when(c("status") == "robots_disallowed", "the host asks not to be crawled, so nothing was requested")
        .otherwise(text("our own storage (", c("status"), ") stood in the way"))
    )


def require_composed(assessed: DataFrame) -> None:
    bad = assessed.select(F.explode("refusals").alias("why")).groupBy("why").count().orderBy("why").collect()  # as many rows as there are reasons
    if bad:
        raise NotComposed("; ".join(f"{r.why}: {r['count']}" for r in bad))


def coverage(assessed: DataFrame) -> DataFrame:
    """The file and its five denominator flags, and whether nothing local stood in the way: failed targets stay in."""
    c = F.col
    problems = F.coalesce(F.size("problems"), F.lit(0)) > 0
    return assessed.select(
        "file_id", F.lit(True).alias("targeted"), (c("attempts") > 0).alias("network_attempted"), c("inspected").alias("verified_body_available"), c("inspected").alias("inspection_performed"),
        (c("inspected") & F.coalesce("scan_completed", F.lit(False))).alias("inspection_scan_completed"), (~problems & ~c("status").isin(INFRASTRUCTURE) & ~(c("status").isin(OBSERVED) & ~c("inspected"))).alias("operationally_complete"),
    )


def dimensions(assessed: DataFrame, found: DataFrame) -> DataFrame:
    """Five rows per file: status, errors, warnings, infos. Without an inspected body the local ones are not assessed, whatever was found."""
    c = F.col
    n = lambda s: F.count(F.when(c("severity") == s, 1))
    per = found.groupBy("file_id", "dimension").agg(n("ERROR").alias("errors"), n("WARNING").alias("warnings"), n("INFO").alias("infos"), F.count("*").alias("codes"))
    every = assessed.select("file_id", "inspected", "scan_completed", "items", "retrievability", F.explode(F.array(*map(F.lit, ALL_DIMENSIONS))).alias("dimension"))
    met = every.join(per, ["file_id", "dimension"], "left")
    remote = c("dimension") == "retrievability"
    unseen = ~c("inspected") | (~c("scan_completed") & c("dimension").isin("completeness", "interpretability")) | ((c("items") == 0) & (c("dimension") == "interpretability"))
    status = F.when(remote, c("retrievability")).when(unseen, "NOT_ASSESSED").when(c("codes") > 0, "FINDINGS").otherwise("OBSERVED")
    local = lambda name: F.when(~remote & c("inspected"), F.coalesce(name, F.lit(0))).otherwise(F.when(remote & (c("retrievability") == "FINDINGS") & F.lit(name == "errors"), 1).otherwise(0)).cast("bigint").alias(name)
    return met.select("file_id", "dimension", status.alias("status"), *map(local, ("errors", "warnings", "infos")))


#: The letters that :func:`grades` gives, and when; a comparison publishes them with their digest.
LETTERS = {"by_failed_dimensions": ["A", "C", "D", "F", "F"], "warned": "B", "not_read": "F", "not_retrievable": "F", "not_known": "NOT_GRADED"}


def grades(assessed: DataFrame, cards: DataFrame, unread: str = "the charge table") -> DataFrame:
    """file_id, grade, reason, error_dimensions (in their fixed order), warning_findings and info_findings. cards: of :func:`dimensions`."""
    c = F.col
    local = c("dimension") != "retrievability"
    failed = local & ((c("errors") > 0) | (c("status") == "NOT_ASSESSED"))
    order = F.array_position(F.array(*map(F.lit, LOCAL_DIMENSIONS)), c("dimension"))
    per = cards.groupBy("file_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct(order.alias("k"), "dimension")))), lambda x: x["dimension"]).alias("failed"), F.sum(F.when(local, c("warnings"))).alias("warned"), F.sum(F.when(local, c("infos"))).alias("told")
    )  # at most four of a file
    met = assessed.join(per, "file_id")
    seen = (c("retrievability") == "OBSERVED") & c("scan_completed")
    n = F.size("failed")
    by_errors = F.create_map(*[F.lit(x) for k, letter in enumerate(LETTERS["by_failed_dimensions"]) for x in (k, letter)])
    letter = (
        F.when(c("retrievability") == "FINDINGS", LETTERS["not_retrievable"]).when(c("retrievability") == "NOT_ASSESSED", LETTERS["not_known"]).when(~c("scan_completed"), LETTERS["not_read"])
        .when((n == 0) & (c("warned") > 0), LETTERS["warned"]).otherwise(by_errors[n])
    )
    kind = media_type(c("content_type"))
    declared = F.when(F.coalesce(kind, F.lit("")) == "", "").when(kind.isin(WEB_PAGES), F.concat(F.lit("; the server called it "), kind, F.lit(", a web page"))).otherwise(F.concat(F.lit("; the server called it "), kind))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    reason = (
        F.when(c("retrievability") == "FINDINGS", text("no verified file came: ", c("note")))
        .when(c("retrievability") == "NOT_ASSESSED", c("note"))
        .when(~c("scan_completed"), text(unread, " couldn't be read to its end", declared, "; what can't be read counts as failed"))
        .when((n == 0) & (c("warned") == 0), "no dimension has an error or a warning")
        .when(n == 0, text("no errors; warnings: ", c("warned").cast("string")))
        .otherwise(text("errors or no evidence in ", n.cast("string"), f" of {len(LOCAL_DIMENSIONS)} dimensions: ", F.array_join("failed", ", ")))
    )
    counted = lambda x: F.when(seen, F.coalesce(x, F.lit(0))).otherwise(0).cast("bigint")
    return met.select("file_id", letter.alias("grade"), reason.alias("reason"), F.when(seen, c("failed")).otherwise(F.array().cast("array<string>")).alias("error_dimensions"), counted(c("warned")).alias("warning_findings"), counted(c("told")).alias("info_findings"))


# What a piece of ingest evidence must say, by its status.
REFUSED = "refused"
REFUSAL_FIELDS = ["source_file_id", "publisher_id", "reason", "implemented_scope", "observed_scope"]
INGEST_FIELDS = ["source_file_id", "publisher_id", "run_id"]


def ingest_evidence(evidence: DataFrame) -> DataFrame:
    """The fields that are published, refusals and runs apart, and ``lacking``: those that should be there and aren't."""
    c = F.col
    refused = c("status") == REFUSED
    blank = lambda f: c(f).isNull() | (c(f) == "")
    lacking = F.filter(F.array(F.when(blank("status"), "status"), *[F.when(F.when(refused, f in REFUSAL_FIELDS).otherwise(f in INGEST_FIELDS) & blank(f), f) for f in dict.fromkeys([*REFUSAL_FIELDS, *INGEST_FIELDS])]), lambda x: x.isNotNull())
    only = lambda when, *names: [F.when(when, c(n)).alias(n) for n in names]
    return evidence.select("status", "source_file_id", "publisher_id", *only(refused, "reason", "implemented_scope", "observed_scope"), *only(~refused, "run_id", "counts"), F.when(~refused, F.coalesce("reused", F.lit(False))).alias("reused"), lacking.alias("lacking"))


def file_rows(assessed: DataFrame, graded: DataFrame, cards: DataFrame, covered: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """A published row per file; addresses without secrets, ingest evidence by content."""
    view = cards.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", F.struct("status", "errors", "warnings", "infos").alias("card"))))).alias("dimensions"))
    flags = [x for x in covered.columns if x not in ("file_id", "operationally_complete")]
    out = assessed.join(graded.select("file_id", F.struct("grade", "reason", "error_dimensions", "warning_findings", "info_findings").alias("grade")), "file_id").join(view, "file_id").join(covered.select("file_id", F.struct(*flags).alias("coverage")), "file_id")
    if evidence is not None:
        out = out.join(evidence.select(F.col("source_file_id").alias("content_sha256"), F.struct(*[x for x in evidence.columns if x != "lacking"]).alias("lakehouse")), "content_sha256", "left")
    else:
        out = out.withColumn("lakehouse", F.lit(None).cast("struct<status:string>"))
    have = lambda x: F.when(F.col("inspected"), F.col(x)) if x in assessed.columns else F.lit(None).cast("string")
    body = out.select(
        F.concat_ws("/", "publisher_id", "location_id").alias("slug"), "publisher_id", have("publisher_name").alias("publisher_name") if "publisher_name" not in assessed.columns else F.col("publisher_name"), "location_id", redact_url(F.col("requested_url")).alias("requested_url"), F.sha2("requested_url", 256).alias("requested_url_sha256"),
        F.col("attempted_at").alias("observed_at"), "as_of", "content_sha256", "size_bytes", "grade", "dimensions", "coverage", have("items").alias("counts"), have("last_updated_on").alias("last_updated_on"), have("version").alias("template_version"), "lakehouse",
    )
    # sealed as assessment records are: canonical JSON, nulls in it, without the two seals themselves
    text = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    own = body.columns
    return body.withColumns({"assessment_id": json_digest(text("as_of", "content_sha256", "observed_at", "requested_url_sha256", "slug")), "assessment_body_sha256": json_digest(text(*own))})
