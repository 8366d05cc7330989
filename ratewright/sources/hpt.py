"""``cms-hpt.txt`` discovery documents: a table function from a document's text to its location records."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

# The keys of a record, in the order of the format.
FIELDS = ["location-name", "source-page-url", "mrf-url", "contact-name", "contact-email"]
RECORD = T.StructType([T.StructField("entry", T.IntegerType()), *[T.StructField(f.replace("-", "_"), T.StringType()) for f in FIELDS], T.StructField("extra", T.MapType(T.StringType(), T.StringType())), T.StructField("problems", T.ArrayType(T.StringType()))])
_CONTROL = re.compile(r"[\s\x00-\x1f\x7f]")


def _url_ok(value: str, schemes: tuple[str, ...]) -> bool:
    try:
        u = urlsplit(value)
        return not _CONTROL.search(value) and u.scheme.lower() in schemes and bool(u.hostname) and u.username is None and u.password is None and u.port != 0
    except ValueError:
        return False


def _email_ok(value: str) -> bool:
    local, at, domain = value.partition("@")
    return bool(local and at and domain) and "@" not in domain and not _CONTROL.search(value) and domain.strip(".") == domain


class _Record:
    def __init__(self):
        self.fields, self.extra, self.problems = {}, {}, []

    def take(self, line: str) -> None:
        key, colon, value = (x.strip() for x in line.partition(":"))
        key = key.lower().replace("_", "-")
        if not colon:
            self.problems.append(f"not a field: {line[:60]}")
        elif not value:
            self.problems.append(f"{key} is empty")
        elif key not in FIELDS:
            self.extra[key] = value
        elif key in self.fields:
            self.problems.append(f"{key} is declared again")
        else:
            self.fields[key] = value

    def complete(self) -> bool:
        return len(self.fields) == len(FIELDS)

    def row(self, k: int) -> tuple:
        f, problems = dict(self.fields), list(self.problems)
        problems += [f"no {x}" for x in FIELDS if x not in f]
        if "mrf-url" in f and not _url_ok(f["mrf-url"], ("https",)):
            problems.append("mrf-url isn't an https address")
            f.pop("mrf-url")
        if "source-page-url" in f and not _url_ok(f["source-page-url"], ("http", "https")):
            problems.append("source-page-url isn't an address")
        if "contact-email" in f and not _email_ok(f["contact-email"]):
            problems.append("contact-email isn't an address")
        return (k, *(f.get(x) for x in FIELDS), self.extra, problems)


def records(text: str | None):
    """Blocks are separated by blank lines, or follow each other where a complete one is followed by one of its keys."""
    body = (text or "").lstrip("\ufeff").strip()
    if not body:
        yield (0, *[None] * len(FIELDS), {}, ["the document is empty"])
        return
    if body.startswith("<") or "<html" in body[:512].lower():
        yield (0, *[None] * len(FIELDS), {}, ["HTML instead of a discovery document"])
        return
    k, record = 0, _Record()
    for line in [*(x.strip().lstrip("\ufeff") for x in body.splitlines()), ""]:
        if line.startswith("#"):
            continue
        key = line.partition(":")[0].strip().lower().replace("_", "-")
        if (not line or (record.complete() and key in record.fields)) and (record.fields or record.extra or record.problems):
            yield record.row(k)
            k, record = k + 1, _Record()
        if line:
            record.take(line)


def register(spark: SparkSession, name: str = "parse_hpt") -> None:
    """SQL: ``SELECT d.domain, h.* FROM documents d, LATERAL parse_hpt(d.text) h``."""

    @udtf(returnType=RECORD)
    class ParseHpt:
        def eval(self, text: str):
            yield from records(text)

    spark.udtf.register(name, ParseHpt)
