"""Row-level checks of CSV charge tables (Tall and Wide), rolled up to findings.

The header of a file (one row) is resolved by a small helper to column places, code pairs and, for Wide tables, the places of each
payer and plan; joined to the file's rows, everything else is expressions on the cells. A row's payer entries are an array of structs
(one for Tall), unfolded once for the checks of entries.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import file_date
from ..sources import sinks
from .contracts import CODE_TYPES, DRUG_TYPES, METHODOLOGIES, SETTINGS, accepted_count
from .findings import check, failing, rollup

# The columns of the template.
GENERAL = ["hospital_name", "last_updated_on", "version", "location_name", "hospital_address", "type_2_npi", "license_number", "attester_name", "attestation"]
SHARED = ["description", "setting", "drug_unit_of_measurement", "drug_type_of_measurement", "standard_charge|gross", "standard_charge|discounted_cash", "modifiers", "standard_charge|min", "standard_charge|max", "additional_generic_notes"]
TALL = ["payer_name", "plan_name", "standard_charge|negotiated_dollar", "standard_charge|negotiated_percentage", "standard_charge|negotiated_algorithm", "median_amount", "10th_percentile", "90th_percentile", "count", "standard_charge|methodology"]
WIDE = ["standard_charge|negotiated_dollar", "standard_charge|negotiated_percentage", "standard_charge|negotiated_algorithm", "standard_charge|methodology", "median_amount", "10th_percentile", "90th_percentile", "count", "additional_payer_notes"]
NUMERIC = ["drug_unit_of_measurement", "standard_charge|gross", "standard_charge|discounted_cash", "standard_charge|min", "standard_charge|max"]
ENTRY_NUMERIC = ["standard_charge|negotiated_dollar", "standard_charge|negotiated_percentage", "median_amount", "10th_percentile", "90th_percentile"]
PLACEHOLDERS = ["[i]", "[payer_name]", "[plan_name]", "[state]"]
VERSION = "3.0.0"
#: How the attestation's column begins; the template fixes the whole sentence, and :func:`inspect` takes it as a parameter.
ATTESTATION_BEGINS = "to the best of its knowledge and belief, this hospital has included all applicable standard charge information"

_PAIR = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("type", T.IntegerType())])
_COMBO = T.StructType([T.StructField("combo", T.StringType()), T.StructField("at", T.MapType(T.StringType(), T.IntegerType()))])
_HEADER = T.StructType([
    T.StructField("names", T.ArrayType(T.StringType())), T.StructField("repeated", T.IntegerType()), T.StructField("placeholders", T.IntegerType()), T.StructField("codes", T.ArrayType(_PAIR)), T.StructField("combos", T.ArrayType(_COMBO)),
])


def normal_header(cell: str) -> str:
    return "|".join(" ".join(s.split()).casefold() for s in (cell or "").split("|"))


def _wide(parts: list[str]) -> tuple[str, str] | None:
    if len(parts) == 4 and parts[0] == "standard_charge":
        element = f"standard_charge|{parts[3]}"
    elif len(parts) == 3 and "|" not in parts[0]:
        element = parts[0]
    else:
        return None
    return (element, f"{parts[1]}|{parts[2]}") if element in WIDE else None


def resolve(cells: list[str] | None) -> dict:
    """What the columns of a charge header mean. names: of plain columns, by place, null elsewhere."""
    names, codes, combos, repeated, placeholders = [], {}, {}, 0, 0
    for k, name in enumerate(map(normal_header, cells or [])):
        plain = None
        if any(p in name for p in PLACEHOLDERS):
            placeholders += 1
        elif m := re.fullmatch(r"code\|(\d+)(\|type)?", name):
            codes.setdefault(int(m[1]), {})["type" if m[2] else "code"] = k
        elif w := _wide(name.split("|")):
            combos.setdefault(w[1], {})[w[0]] = k
        elif name and name in names:
            repeated += 1
        elif name:
            plain = name
        names.append(plain)
    return {"names": names, "repeated": repeated, "placeholders": placeholders, "codes": [{"code": c.get("code"), "type": c.get("type")} for _, c in sorted(codes.items())], "combos": [{"combo": c, "at": at} for c, at in sorted(combos.items())]}


_resolve = F.udf(lambda cells: resolve(cells), _HEADER)


def filled(c: Column) -> Column:
    # the first character tells of most cells, without a regular expression
    return F.when(F.ascii(c).between(33, 126), True).when(c == "", False).otherwise(F.coalesce(c.rlike(r"(?U)\S"), F.lit(False)))


def folded(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def positive(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    value = F.when(t.rlike(r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), t.try_cast("double"))
    return F.coalesce((value > 0) & (value < float("inf")), F.lit(False))


def count_ok(c: Column) -> Column:
    return accepted_count(folded(c))


def _at(k: Column) -> Column:
    """The cell at a place from 0; blank beyond the row's end."""
    return F.coalesce(F.try_element_at("cells", k + 1), F.lit(""))


_PLACES = [*SHARED, *TALL]


def _places() -> Column:
    """Where the template's columns are in a header, from 1; worked out once for a file."""
    return F.struct(*[F.coalesce(F.array_position("header.names", n), F.lit(0)).cast("int").alias(f"p{k}") for k, n in enumerate(_PLACES)])


def _named(name: str) -> Column:
    k = F.col(f"places.p{_PLACES.index(name)}")
    return F.when(k > 0, _at(k - 1)).otherwise("")


def err(condition: Column, code: str, dimension: str, message: str) -> Column:
    return check(condition, f"CMS_CSV_{code}", dimension, "ERROR", message)


def _entry_checks(entry: Column) -> list[Column]:
    e = lambda n: entry[n]
    derived = filled(e("percentage")) | filled(e("algorithm"))
    charged = derived | filled(e("dollar"))
    method = folded(e("methodology"))
    zero = F.trim(e("count")) == "0"
    quantiles = filled(e("median")) & filled(e("p10")) & filled(e("p90"))
    named = filled(e("payer")) & filled(e("plan"))
    return [
        err(charged & ~(filled(method) & (named | F.col("wide"))), "PAYER_CONTEXT_MISSING", "completeness", "a charge without payer, plan or methodology"),
        err(~F.col("wide") & (filled(e("payer")) | filled(e("plan"))) & ~charged, "PAYER_WITHOUT_CHARGE", "completeness", "a payer or plan without a charge"),
        err((method == "other") & ~entry["notes"], "OTHER_METHODOLOGY_NOTES_MISSING", "completeness", "methodology 'other' needs a note"),
        err(derived & ~filled(e("count")), "DERIVED_RATE_COUNT_MISSING", "completeness", "a derived rate has no count"),
        err(derived & filled(e("count")) & ~zero & ~quantiles, "DERIVED_RATE_PERCENTILES_MISSING", "completeness", "a derived rate lacks an allowed amount"),
        err(derived & zero & ~entry["notes"], "ZERO_COUNT_NOTES_MISSING", "completeness", "a derived rate with count 0 needs a note"),
        err(filled(e("count")) & ~count_ok(e("count")), "COUNT_VALUE_INVALID", "conformance", "a count isn't one of the accepted forms"),
        err(filled(method) & ~method.isin(METHODOLOGIES), "METHODOLOGY_INVALID", "conformance", "a methodology isn't one of the accepted values"),
    ]


def _row_checks() -> list[Column]:
    has = lambda n: filled(_named(n))
    codes = F.col("pairs")
    both = lambda p: filled(p["code"]) & filled(p["type"])
    complete = F.size(F.filter(codes, both))
    ndc = F.exists(codes, lambda p: both(p) & (folded(p["type"]) == "ndc"))
    unpaired = F.exists(codes, lambda p: filled(p["code"]) != filled(p["type"]))
    dollars = F.exists("entries", lambda e: filled(e["dollar"]))
    paid = F.exists("entries", lambda e: filled(e["dollar"]) | filled(e["percentage"]) | filled(e["algorithm"]))
    charge = has("standard_charge|gross") | has("standard_charge|discounted_cash") | paid
    item = complete > 0
    modifier = has("modifiers") & ~item
    noted = paid | has("additional_generic_notes") | F.exists("entries", lambda e: filled(e["payer_notes"]))
    unit, kind = has("drug_unit_of_measurement"), has("drug_type_of_measurement")
    setting, drug = folded(_named("setting")), folded(_named("drug_type_of_measurement"))
    beyond = F.exists(F.slice("cells", F.col("header.width") + 1, F.greatest(F.size("cells"), F.lit(1))), filled)
    return [
        err(beyond, "ROW_WIDTH_MISMATCH", "conformance", "a row has cells beyond the declared columns"),
        err(filled(setting) & ~setting.isin(SETTINGS), "SETTING_INVALID", "conformance", "a setting isn't one of the accepted values"),
        err(item & charge & ~has("setting"), "SETTING_INVALID", "conformance", "a setting is blank where it is required"),
        err(filled(drug) & ~drug.isin([d.lower() for d in DRUG_TYPES]), "DRUG_TYPE_INVALID", "conformance", "a drug type isn't one of the accepted values"),
        err(unpaired, "CODE_TYPE_UNPAIRED", "completeness", "a code without type or a type without code"),
        err(charge & ~item & ~modifier, "CODE_PAIRING_MISSING", "completeness", "a charge without a code"),
        err(item & ~has("description"), "DESCRIPTION_MISSING", "completeness", "an item has no description"),
        err((item & ~charge) | (~item & ~has("modifiers") & has("description") & ~charge), "CHARGE_VALUE_MISSING", "completeness", "an item or service has no charge"),
        err(modifier & ~(has("description") & noted), "MODIFIER_ROW_CONTEXT_MISSING", "completeness", "a modifier row lacks description, charge or note"),
        err(dollars & ~(has("standard_charge|min") & has("standard_charge|max")), "DOLLAR_RANGE_MISSING", "completeness", "a dollar rate lacks minimum or maximum"),
        err(unit != kind, "DRUG_FIELDS_UNPAIRED", "completeness", "a drug unit without type or a type without unit"),
        err(ndc & ~(unit & kind), "NDC_DRUG_FIELDS_MISSING", "completeness", "an NDC code without drug unit or type"),
    ]


def _file_checks(files: DataFrame, as_of: date, attestation: str) -> DataFrame:
    value = lambda n: F.try_element_at("general", F.lit(n))
    usable = {n: filled(value(n)) for n in GENERAL}
    attested = folded(F.element_at(F.concat(F.map_values(F.map_filter("general", lambda k, _: k.startswith(attestation))), F.array(F.lit(""))), 1))
    usable["attestation"] = attested.isin("true", "false")
    usable["license_number"] = F.exists(F.map_keys("general"), lambda k: k.rlike(r"\Alicense_number\|[a-z]{2}\z"))
    day = file_date(F.trim(value("last_updated_on")))
    now = F.lit(as_of.isoformat()).cast("date")
    column = lambda n: F.coalesce(F.array_contains("header.names", n), F.lit(False))  # names holds nulls
    tall, wide = column("payer_name") | column("plan_name"), F.size("header.combos") > 0
    headed, complete = F.col("header").isNotNull(), F.col("broken").isNull()
    pair = F.exists("header.codes", lambda p: p["code"].isNotNull() & p["type"].isNotNull())
    c = lambda n: n.upper().replace("|", "_").removeprefix("STANDARD_CHARGE_")
    conf = "conformance"
    checks = [err(~F.coalesce(usable[n], F.lit(False)), f"GENERAL_{n.upper()}_MISSING", conf, f"general element {n} is absent or unusable") for n in GENERAL]
    checks += [err(headed & ~column(n) & (~wide if n in TALL else F.lit(True)), f"COLUMN_{c(n)}_MISSING", conf, f"column {n} is absent") for n in [*SHARED, *TALL]]
    checks += [
        err(headed & ~pair, "COLUMN_CODE_PAIR_MISSING", conf, "there is no complete pair of code columns"),
        err(~headed, "CHARGE_HEADER_ROW_MISSING", conf, "the file ends before its charge header"),
        err(tall & wide, "LAYOUT_AMBIGUOUS", conf, "Tall and Wide columns are mixed; read as Wide"),
        err(filled(value("version")) & (F.trim(value("version")) != VERSION), "VERSION_UNEXPECTED", conf, f"the template version isn't {VERSION}"),
        err(filled(value("last_updated_on")) & day.isNull(), "LAST_UPDATED_ON_INVALID", conf, "last_updated_on isn't a date"),
        err(F.exists(F.map_keys("general"), lambda k: k == "license_number|[state]"), "PLACEHOLDER_NOT_REPLACED", conf, "the state's placeholder wasn't replaced"),
        check(attested == "false", "CMS_CSV_ATTESTATION_NOT_CONFIRMED", conf, "WARNING", "the attestation is explicitly false"),
        check(F.col("bom"), "CMS_CSV_UTF8_BOM_PRESENT", conf, "INFO", "a byte-order mark was tolerated"),
        check(F.col("encoding") == "latin-1", "CMS_CSV_ENCODING_NOT_UTF8", conf, "INFO", "the file isn't UTF-8 and was read as Latin-1"),
        err(~complete, "STREAM_INCOMPLETE", conf, "the file couldn't be read to its end"),
        err(headed & complete & (F.col("n_rows") == 0), "TABLE_EMPTY", "completeness", "there are no rows below the header"),
        check(day.isNull(), "CSV_FRESHNESS_DATE_NOT_USABLE", "freshness", "ERROR", "there is no usable date"),
        check(day > now, "FRESHNESS_DATE_IN_FUTURE", "freshness", "WARNING", "the date is after the day of inspection"),
        check(now > F.add_months(day, 12), "FRESHNESS_ANNUAL_UPDATE_OVERDUE", "freshness", "WARNING", "the date is more than a year back"),
        check(complete & (F.col("n_rows") > 0) & (F.col("payers") == 0), "CSV_INTERPRETABILITY_NO_PAYER_RATES", "interpretability", "WARNING", "no payer rate was seen"),
        check(complete & (F.col("percentages") > 0), "CSV_INTERPRETABILITY_PERCENTAGE_RATES", "interpretability", "INFO", "percentages aren't dollar amounts"),
        check(complete & (F.col("algorithms") > 0), "CSV_INTERPRETABILITY_ALGORITHM_RATES", "interpretability", "INFO", "algorithms aren't dollar amounts"),
    ]
    single = failing(files, checks, "file_id").withColumn("n", F.lit(1).cast("bigint"))
    incomplete = F.size(F.filter("header.combos", lambda x: F.size(x["at"]) < len(WIDE))).cast("bigint")
    several = [
        ("HEADER_NOT_UNIQUE", F.col("header.repeated").cast("bigint"), "a column's name appears more than once"),
        ("PLACEHOLDER_NOT_REPLACED", F.col("header.placeholders").cast("bigint"), "a header's placeholder wasn't replaced"),
        ("WIDE_PAYER_HEADER_SET_INCOMPLETE", incomplete, "a payer and plan lack some of their nine columns"),
    ]
    many = files.select("file_id", F.inline(F.array(*[F.struct(F.lit(100 + k).alias("rule"), F.lit(f"CMS_CSV_{code}").alias("code"), F.lit(conf).alias("dimension"), F.lit("ERROR").alias("severity"), F.lit(m).alias("message"), n.alias("n")) for k, (code, n, m) in enumerate(several)]))).where("n > 0")
    return single.unionByName(many)


def inspect(rows: DataFrame, as_of: date, attestation: str = ATTESTATION_BEGINS) -> DataFrame:
    """Findings of every file among rows of ``charge_csv`` (with a ``file_id``): code, dimension, severity, message, occurrences."""
    pick = lambda k: F.max(F.when(F.col("row_index") == k, F.col("cells")))
    heads = rows.groupBy("file_id").agg(
        pick(0).alias("names"), pick(1).alias("values"), pick(2).alias("columns"), F.max("bom").alias("bom"), F.max("encoding").alias("encoding"), F.max("problem").alias("broken"),
        F.count(F.when((F.col("row_index") > 2) & F.exists("cells", filled), 1)).alias("n_rows"),
    )
    cells = F.arrays_zip(F.transform("names", lambda c: F.array_join(F.transform(F.split(c, r"\|"), folded), "|")).alias("k"), F.col("values").alias("v"))
    entries = F.filter(F.transform(cells, lambda x: F.struct(F.regexp_replace(x["k"], r"\Alicense_number\|([a-z]{2})\z", "license_number|$1").alias("key"), F.coalesce(x["v"], F.lit("")).alias("value"))), lambda x: x["key"].isNotNull() & (x["key"] != ""))
    first = F.aggregate(entries, F.array().cast("array<struct<key:string,value:string>>"), lambda s, x: F.when(F.exists(s, lambda y: y["key"] == x["key"]), s).otherwise(F.concat(s, F.array(x))))
    heads = heads.withColumns({"general": F.coalesce(F.map_from_entries(first), F.create_map().cast("map<string,string>")), "header": F.when(F.col("columns").isNotNull(), _resolve("columns"))}).drop("names", "values", "columns")
    heads = heads.withColumn("places", _places())
    # one row per file; computed once, as the helper is Python
    kept = sinks.scratch(rows.sparkSession, "charge-headers")
    heads.write.parquet(kept)
    heads = rows.sparkSession.read.schema(heads.schema).parquet(kept)
    body = rows.where((F.col("row_index") > 2) & F.exists("cells", filled)).select("file_id", "row_index", "cells").join(heads.select("file_id", F.struct(F.size("header.names").alias("width"), "header.codes", "header.combos").alias("header"), "places"), "file_id")
    body = body.withColumn("wide", F.size("header.combos") > 0)
    generic = filled(_named("additional_generic_notes"))
    short = {"standard_charge|negotiated_dollar": "dollar", "standard_charge|negotiated_percentage": "percentage", "standard_charge|negotiated_algorithm": "algorithm", "standard_charge|methodology": "methodology", "median_amount": "median", "10th_percentile": "p10", "90th_percentile": "p90", "count": "count"}
    combo = lambda x, n: F.coalesce(F.when(F.try_element_at(x["at"], F.lit(n)).isNotNull(), _at(F.try_element_at(x["at"], F.lit(n)))), F.lit(""))
    wide_entry = lambda x: F.struct(F.lit("").alias("payer"), F.lit("").alias("plan"), *[combo(x, n).alias(s) for n, s in short.items()], combo(x, "additional_payer_notes").alias("payer_notes"), (generic | filled(combo(x, "additional_payer_notes"))).alias("notes"))
    tall_entry = F.struct(_named("payer_name").alias("payer"), _named("plan_name").alias("plan"), *[_named(n).alias(s) for n, s in short.items()], F.lit("").alias("payer_notes"), generic.alias("notes"))
    body = body.withColumns({
        "pairs": F.transform("header.codes", lambda p: F.struct(F.coalesce(F.when(p["code"].isNotNull(), _at(p["code"])), F.lit("")).alias("code"), F.coalesce(F.when(p["type"].isNotNull(), _at(p["type"])), F.lit("")).alias("type"))),
        "entries": F.when(F.col("wide"), F.transform("header.combos", wide_entry)).otherwise(F.array(tall_entry)),
    })
    numbers = F.concat(F.array(*map(_named, NUMERIC)), F.flatten(F.transform("entries", lambda e: F.array(*[e[short[n]] for n in ENTRY_NUMERIC]))))
    f = lambda e, n: filled(e[n])
    # a combination whose cells are all blank can't fail a check
    body = body.withColumn("entries", F.filter("entries", lambda e: F.exists(F.array(*[e[s] for s in ("payer", "plan", *short.values())]), filled)))
    some = lambda checks: F.filter(F.array(*checks), lambda x: x.isNotNull())
    each = F.concat(some(_row_checks()), F.flatten(F.transform("entries", lambda e: some(_entry_checks(e)))))
    counted = lambda n, code, message: F.struct(F.lit(f"CMS_CSV_{code}").alias("code"), F.lit("conformance").alias("dimension"), F.lit("ERROR").alias("severity"), F.lit(message).alias("message"), n.cast("bigint").alias("n"))
    types = F.size(F.filter("pairs", lambda p: filled(p["type"]) & ~folded(p["type"]).isin([x.lower() for x in CODE_TYPES])))
    wrong = F.size(F.filter(numbers, lambda x: filled(x) & ~positive(x)))
    found = F.concat(
        F.transform(each, lambda x: F.struct(x["code"].alias("code"), x["dimension"].alias("dimension"), x["severity"].alias("severity"), x["message"].alias("message"), F.lit(1).cast("bigint").alias("n"))),
        F.filter(F.array(counted(types, "CODE_TYPE_INVALID", "a code type isn't one of the accepted values"), counted(wrong, "NUMERIC_VALUE_INVALID", "a number isn't positive or isn't a number")), lambda x: x["n"] > 0),
    )
    paid = lambda e: f(e, "dollar") | f(e, "percentage") | f(e, "algorithm") | f(e, "payer") | f(e, "plan")
    size = lambda test: F.size(F.filter("entries", test))
    # every row is judged in one pass, of which the findings and a few numbers are kept
    light = body.select("file_id", "row_index", found.alias("found"), size(paid).alias("payers"), size(lambda e: f(e, "percentage")).alias("percentages"), size(lambda e: f(e, "algorithm")).alias("algorithms"))
    kept = sinks.scratch(rows.sparkSession, "csv-findings")
    light.write.parquet(kept)
    light = rows.sparkSession.read.schema(light.schema).parquet(kept)
    seen = light.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in ("payers", "percentages", "algorithms")])
    files = heads.join(seen, "file_id", "left").na.fill(0, ["payers", "percentages", "algorithms"])
    of_files = _file_checks(files, as_of, attestation).withColumn("row_index", F.lit(-1).cast("bigint"))
    of_rows = light.where(F.size("found") > 0).select("file_id", "row_index", F.posexplode("found").alias("rule", "f")).select("file_id", "row_index", "rule", "f.*")
    return rollup(of_files.unionByName(of_rows), "file_id", position=["row_index", "rule"], occurrences="n")
