"""Assessment records: one sealed JSON record for each assessed file, and the verification that derives each part again from the others.

A record holds its evidence (subject, retrieval, retrieval policy, inspection with its findings) and what follows from it (dimensions, coverage, scope,
identity, seals). :func:`verify` trusts nothing of the second kind: it derives it within the row and names the first part that differs, so that a
record of which any part was changed has a reason of its own. Seals and identities are digests of canonical JSON (:mod:`..functions.canonical`).

Defined cases: a line that isn't strict JSON is no record; a missing or wrongly typed part counts as one that differs; further fields are
sealed with the rest and otherwise ignored; blank lines are no records (the reader leaves them out); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical
from ..functions.dates import utc_date
from ..functions.text import redact_problem
from .findings import ALL_DIMENSIONS, LOCAL_DIMENSIONS, OBSERVED, retrievability

VERSION = 1
CUSTOM = "custom"
SCOPE = ["as_of", "assessment_policy_fingerprint", "profile", "publisher_type", "retrieval_policy_fingerprint", "url_provenance"]
FLAGS = ["inspection_performed", "inspection_scan_completed", "network_attempted", "targeted", "verified_body_available"]
CARD = "struct<status:string,errors:bigint,warnings:bigint,infos:bigint>"
RECORD = f"""version int, as_of string, observed_at string, assessment_id string, assessment_body_sha256 string, retrieval_evidence_sha256 string, assessment_policy_fingerprint string, profile string,
    subject struct<requested_url:string,requested_url_sha256:string,location_id:string,publisher_type:string,url_provenance:string,publisher:struct<identifier:string,name:string>>,
    retrieval struct<url:string,attempted_at:string,status:string,http_status:int,attempts:int,error:string,content_sha256:string,size_bytes:bigint>, retrieval_policy struct<fingerprint:string,execution_strategy:string>,
    inspection struct<source_sha256:string,source_size:bigint,as_of:string,publisher:string,scan_completed:boolean,items:bigint,findings:array<struct<code:string,dimension:string,severity:string,occurrences:bigint>>,local_dimensions:map<string,{CARD}>>,
    scorecard map<string,{CARD}>, coverage map<string,boolean>, operational_problems array<string>, comparison_scope map<string,string>"""
_SEALS = ("assessment_id", "assessment_body_sha256")


def identity(record: dict) -> str:
    """What an assessment is of; two records of one identity are one assessment."""
    subject, inspection = record["subject"], record.get("inspection")
    return canonical.digest({
        "as_of": record["as_of"], "observed_at": record["observed_at"], "version": record["version"], "assessment_policy_fingerprint": record["assessment_policy_fingerprint"], "retrieval_policy_fingerprint": record["retrieval_policy"]["fingerprint"],
        "retrieval_evidence_sha256": record["retrieval_evidence_sha256"], "inspection_source_sha256": inspection["source_sha256"] if inspection else None,
        "subject": {"publisher_identifier": subject["publisher"]["identifier"], **{k: subject.get(k) for k in ("location_id", "publisher_type", "requested_url", "requested_url_sha256", "url_provenance")}},
    })


def without(value: dict, *keys: str) -> dict:
    return {k: v for k, v in value.items() if k not in keys}


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@functools.lru_cache(maxsize=1024)
def _policy(text: str) -> tuple[str, str]:
    """The fingerprint of a policy, and its canonical text with it. Policies are few."""
    plain = without(canonical.load(text), "fingerprint")
    fingerprint = canonical.digest(plain)
    return fingerprint, canonical.dump(plain | {"fingerprint": fingerprint})


def _seals(record: dict) -> dict:
    """The digests that a record ought to have."""
    policy = record["retrieval_policy"]
    return {"body": canonical.digest(without(record, *_SEALS)), "retrieval": canonical.digest(record["retrieval"]), "policy": canonical.digest(without(policy, "fingerprint")), "identity": identity(record)}


_seal_text = canonical.mapped(T.StringType(), lambda record: canonical.dump(_seals(record)))


def _sealed(read: tuple[dict, dict[str, str], str]) -> str:
    record, texts, _ = read
    fingerprint, texts["retrieval_policy"] = _policy(texts["retrieval_policy"])
    record["retrieval_policy"] = {"fingerprint": fingerprint}
    scope = record["comparison_scope"]
    scope.setdefault("retrieval_policy_fingerprint", None)
    if scope["retrieval_policy_fingerprint"] is None:
        scope["retrieval_policy_fingerprint"] = fingerprint
    texts["comparison_scope"] = canonical.dump(scope)
    record["retrieval_evidence_sha256"] = _sha256(texts["retrieval"])
    texts["retrieval_evidence_sha256"] = canonical.dump(record["retrieval_evidence_sha256"])
    body = without(texts, *_SEALS)
    return canonical.joined(body | {"assessment_id": canonical.dump(identity(record)), "assessment_body_sha256": canonical.dump(_sha256(canonical.joined(body)))})


#: The canonical text of a record (JSON text) with its policy's fingerprint, its identity and its seals.
sealed_record = canonical.mapped(T.StringType(), _sealed, canonical.members)


def _cards(findings: Column, scan_completed: Column, items: Column) -> dict[str, Column]:
    """The local dimensions that an inspection's findings give."""
    many = lambda d, s: F.size(F.filter(findings, lambda f: (f["dimension"] == d) & (f["severity"] == s) if s else f["dimension"] == d)).cast("bigint")
    out = {}
    for d in LOCAL_DIMENSIONS:
        unseen = F.lit(False)
        if d in ("completeness", "interpretability"):
            unseen = ~scan_completed
        if d == "interpretability":
            unseen = unseen | (items == 0)
        status = F.when(unseen, "NOT_ASSESSED").when(many(d, None) > 0, "FINDINGS").otherwise("OBSERVED")
        out[d] = F.struct(status.alias("status"), *[many(d, s).alias(n) for n, s in (("errors", "ERROR"), ("warnings", "WARNING"), ("infos", "INFO"))])
    return out


def _card(status: Column, errors: Column | int = 0) -> Column:
    n = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    return F.struct(status.alias("status"), n(errors).alias("errors"), n(0).alias("warnings"), n(0).alias("infos"))


def build(assessed: DataFrame, found: DataFrame, policy: Column, policy_fingerprint: str, profile: str, publisher_type: str = "hospital", url_provenance: str = "operator") -> DataFrame:
    """file_id and value, a sealed record's text. assessed: as :func:`.scorecard.compose` gives it; found: file_id, code, dimension, severity, occurrences; policy: a struct."""
    c = F.col
    per = found.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("code", "dimension", "severity", c("occurrences").cast("bigint").alias("occurrences")))).alias("findings"))  # a few dozen codes at most
    met = assessed.join(per, "file_id", "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<code:string,dimension:string,severity:string,occurrences:bigint>>")))
    met = met.withColumns({"done": F.coalesce("scan_completed", F.lit(False)), "day": c("as_of").cast("string")})
    local = _cards(c("findings"), c("done"), c("items"))
    failed = c("retrievability") == "FINDINGS"
    cards = {d: F.when(c("inspected"), x).otherwise(_card(F.lit("NOT_ASSESSED"))) for d, x in local.items()} | {"retrievability": _card(c("retrievability"), failed.cast("bigint"))}
    inspection = F.struct("source_sha256", "source_size", c("inspected_as_of").cast("string").alias("as_of"), c("inspected_publisher").cast("string").alias("publisher"), c("done").alias("scan_completed"), "items", "findings", F.struct(*[x.alias(d) for d, x in local.items()]).alias("local_dimensions"))
    body = F.struct(
        F.lit(VERSION).alias("version"), c("day").alias("as_of"), c("attempted_at").alias("observed_at"), F.lit(policy_fingerprint).alias("assessment_policy_fingerprint"), F.lit(profile).alias("profile"),
        F.struct("requested_url", F.sha2("requested_url", 256).alias("requested_url_sha256"), "location_id", F.lit(publisher_type).alias("publisher_type"), F.lit(url_provenance).alias("url_provenance"), F.struct(c("publisher_id").cast("string").alias("identifier")).alias("publisher")).alias("subject"),
        F.struct("url", "attempted_at", "status", "http_status", "attempts", "error", "content_sha256", "size_bytes").alias("retrieval"), policy.alias("retrieval_policy"), F.when(c("inspected"), inspection).alias("inspection"), F.struct(*[x.alias(d) for d, x in cards.items()]).alias("scorecard"),
        F.struct(c("inspected").alias("inspection_performed"), (c("inspected") & c("done")).alias("inspection_scan_completed"), (c("attempts") > 0).alias("network_attempted"), F.lit(True).alias("targeted"), c("inspected").alias("verified_body_available")).alias("coverage"),
        F.coalesce(F.transform("problems", lambda p: redact_problem(p)), F.array().cast("array<string>")).alias("operational_problems"),
        F.struct(c("day").alias("as_of"), F.lit(policy_fingerprint).alias("assessment_policy_fingerprint"), F.lit(profile).alias("profile"), F.lit(publisher_type).alias("publisher_type"), F.lit(None).cast("string").alias("retrieval_policy_fingerprint"), F.lit(url_provenance).alias("url_provenance")).alias("comparison_scope"),
    )
    return met.select("file_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def verify(lines: DataFrame, version: int = VERSION) -> DataFrame:
    """lines (``value``) with assessment_id, as_of, publisher_id, status, strategy, scope (canonical text) and ``problem``, the first part that differs from what the rest says."""
    c = F.col
    sealed = lines.withColumn("s_", _seal_text(c("value")))
    # unfolded: a filter by ``problem`` would sink below a projection, and parse the line again for each of its dozens of uses there
    parsed = sealed.select(*lines.columns, F.inline(F.array(F.struct(F.from_json("value", RECORD).alias("r"), F.from_json("s_", "body string, retrieval string, policy string, identity string").alias("s")))))
    r, s = (lambda x: c(f"r.{x}")), (lambda x: c(f"s.{x}"))
    inspected, success = r("inspection").isNotNull(), r("retrieval.status").isin(OBSERVED)
    problems = F.size("r.operational_problems") > 0
    told = retrievability(r("retrieval.status"), r("retrieval.http_status"), r("retrieval.attempts"), r("retrieval.error"), inspected, problems)["status"]
    local = _cards(r("inspection.findings"), r("inspection.scan_completed"), r("inspection.items"))
    same_cards = lambda cards, want: F.aggregate(F.array(*[cards[d].eqNullSafe(x) for d, x in want.items()]), F.lit(True), lambda a, b: a & b)
    none = {d: _card(F.lit("NOT_ASSESSED")) for d in LOCAL_DIMENSIONS}
    flags = {"inspection_performed": inspected, "inspection_scan_completed": inspected & F.coalesce(r("inspection.scan_completed"), F.lit(False)), "network_attempted": r("retrieval.attempts") > 0, "targeted": F.lit(True), "verified_body_available": inspected}
    scope = {"as_of": r("as_of"), "assessment_policy_fingerprint": r("assessment_policy_fingerprint"), "profile": r("profile"), "publisher_type": r("subject.publisher_type"), "retrieval_policy_fingerprint": r("retrieval_policy.fingerprint"), "url_provenance": r("subject.url_provenance")}
    every = lambda have, want: F.aggregate(F.array(F.size(F.map_keys(have)) == len(want), *[have[k].eqNullSafe(v) for k, v in want.items()]), F.lit(True), lambda a, b: a & b)
    differs = lambda a, b: ~a.eqNullSafe(b)
    reasons = [
        (c("s").isNull() | c("r").isNull() | s("body").isNull(), "not a record"), (r("version") != version, "another version"), (s("body") != r("assessment_body_sha256"), "the body isn't what was sealed"), (s("retrieval") != r("retrieval_evidence_sha256"), "the retrieval isn't what was sealed"),
        (s("policy") != r("retrieval_policy.fingerprint"), "the policy isn't what was sealed"), (r("subject.requested_url") != r("retrieval.url"), "another address was retrieved"), (F.sha2("r.subject.requested_url", 256) != r("subject.requested_url_sha256"), "the address isn't that of its digest"),
        (r("observed_at") != r("retrieval.attempted_at"), "the times of observation differ"), (utc_date(r("observed_at")).cast("string") != r("as_of"), "the day isn't that of the retrieval"), (r("comparison_scope")["as_of"] != r("as_of"), "the scope is of another day"),
        (~every(r("comparison_scope"), scope), "the scope isn't that of its parts"), (s("identity") != r("assessment_id"), "the identity isn't that of its parts"), (inspected & ~success, "only a successful retrieval can have an inspection"),
        (inspected & differs(r("inspection.as_of"), r("as_of")), "the days of inspection and retrieval differ"), (inspected & differs(r("inspection.publisher"), r("subject.publisher.identifier")), "the inspection is of another publisher"),
        (inspected & (differs(r("inspection.source_sha256"), r("retrieval.content_sha256")) | r("inspection.source_sha256").isNull()), "other bytes were inspected"), (inspected & differs(r("inspection.source_size"), r("retrieval.size_bytes")), "another number of bytes was inspected"),
        (r("operational_problems").isNull() | F.exists("r.operational_problems", lambda p: p.isNull() | (redact_problem(p) != p)), "a problem isn't fit for publication"), ((r("retrieval.attempts") < 0), "the retrieval has fewer than no attempts"),
        (differs(r("scorecard")["retrievability"], _card(told, (told == "FINDINGS").cast("bigint"))), "the retrievability isn't what the retrieval says"),
        (F.when(inspected, ~(same_cards(r("inspection.local_dimensions"), local) & same_cards(r("scorecard"), local))).otherwise(~same_cards(r("scorecard"), none)) | (F.size(F.map_keys("r.scorecard")) != len(ALL_DIMENSIONS)), "the local dimensions aren't what the findings say"),
        (~every(r("coverage"), flags), "the coverage isn't what was done"),
    ]
    problem = F.lit(None).cast("string")
    for test, why in reversed(reasons):
        problem = F.when(F.coalesce(test, F.lit(True)), why).otherwise(problem)
    scope_text = F.to_json(F.struct(*[r("comparison_scope")[k].alias(k) for k in SCOPE]), {"ignoreNullFields": "false"})
    return parsed.select(*lines.columns, r("assessment_id").alias("assessment_id"), r("as_of").alias("as_of"), r("subject.publisher.identifier").alias("publisher_id"), r("retrieval.status").alias("status"), r("retrieval_policy.execution_strategy").alias("strategy"), scope_text.alias("scope"), problem.alias("problem"))


class NotComparable(ValueError):
    """Records that can't stand in one comparison; the message says why."""


def require_comparable(records: DataFrame) -> DataFrame:
    """The records (of :func:`verify`) if all are good, retrieved in the standard way and of one scope; else the first reason that they aren't."""
    shape = records.agg(F.count("*").alias("n"), F.count("problem").alias("bad"), F.count(F.when(F.col("strategy") == CUSTOM, 1)).alias("custom"), F.min("scope").alias("least"), F.max("scope").alias("most")).first()
    if shape.bad:
        raise NotComparable(f"{shape.bad} of {shape.n} records can't be trusted")
    if shape.n > 1 and shape.custom:
        raise NotComparable(f"{shape.custom} records were retrieved in a custom way, which is comparable with nothing")
    if shape.least != shape.most:
        raise NotComparable(f"the scopes differ: {shape.least} and {shape.most}")
    return records
