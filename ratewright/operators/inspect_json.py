"""Row-level checks of JSON charge documents, rolled up to findings.

Each payload is parsed once and unfolded to its payer rates; every level (item, code, charge group, payer rate) is checked by one array of
conditions at its first row, and what was found is kept before files are judged. A missing key and a null are told apart. Messages of a code are those of its first place in the document.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_line, redact_problem
from ..sources import sinks
from . import normalize as N
from .contracts import METHODOLOGIES, SETTINGS
from .findings import check, failing, rollup

# The envelope's fields by what makes them usable.
TEXT_FIELDS = ["hospital_name", "last_updated_on", "version"]
LIST_FIELDS = ["location_name", "hospital_address", "type_2_npi"]
VERSION = "3.0.0"
ARRAY = "standard_charge_information"
#: Characters of a value that a message shows.
SHOWN = 80


def error(condition: Column, code: str, dimension: str, message: str) -> Column:
    return check(condition, code, dimension, "ERROR", message)


def missing(condition: Column, code: str, message: str) -> Column:
    return error(condition, f"CMS_V3_{code}", "completeness", message)


def wrong(condition: Column, code: str, message: str | Column) -> Column:
    return error(condition, f"CMS_V3_{code}", "conformance", message)


def with_value(message: str, value: Column) -> Column:
    """The message and the value that it is about, as JSON of one line, short and fit for publication; the roll-up keeps that of the first place."""
    return F.concat(F.lit(f"{message}: "), F.coalesce(redact_problem(one_line(F.to_json(value)), SHOWN), F.lit("absent")))


def no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _size(list_: Column) -> Column:
    return F.coalesce(F.size(list_), F.lit(0))


def _is_text(v: Column) -> Column:
    return F.coalesce(N.string(v).isNotNull(), F.lit(False))


def _object(v: Column) -> Column:
    return F.coalesce(N.is_object(v), F.lit(False))


def _field_ok(name: str) -> Column:
    v = F.try_parse_json(F.try_element_at("fields", F.lit(name)))
    if name in TEXT_FIELDS:
        return _is_text(v)
    if name in LIST_FIELDS:
        list_ = N.elements(v)
        return (_size(list_) > 0) & F.coalesce(F.forall(list_, _is_text), F.lit(False))
    if name == "license_information":
        return _object(v) & _is_text(N.field(v, "$.state"))
    return _object(v) & _is_text(N.field(v, "$.attestation")) & F.coalesce(N.kind_of(N.field(v, "$.confirm_attestation")) == "BOOLEAN", F.lit(False)) & _is_text(N.field(v, "$.attester_name"))


def file_checks(files: DataFrame, as_of: date) -> DataFrame:
    """files: the envelope with counts of payer rates, percentage_rates and algorithm_rates."""
    v = lambda name: F.try_parse_json(F.try_element_at("fields", F.lit(name)))
    version = N.string(v("version"))
    raw_day = v("last_updated_on")
    day_text = F.when(N.kind_of(raw_day) == "STRING", F.try_variant_get(raw_day, "$", "string"))
    day = F.when(day_text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(day_text, "yyyy-MM-dd"))
    now = F.lit(as_of.isoformat()).cast("date")
    confirmed = F.try_variant_get(v("attestation"), "$.confirm_attestation", "boolean")
    complete = F.col("broken").isNull()
    checks = [wrong(~_field_ok(f), f"ENVELOPE_{f.upper()}_MISSING", f"required envelope field {f} is absent or unusable") for f in [*TEXT_FIELDS, *LIST_FIELDS, "license_information", "attestation"]]
    checks += [
        wrong(version.isNotNull() & (version != VERSION), "VERSION_UNEXPECTED", with_value(f"the template version isn't {VERSION}", v("version"))),
        wrong(N.usable(raw_day) & day.isNull(), "LAST_UPDATED_ON_INVALID", with_value("last_updated_on isn't a date of the form YYYY-MM-DD", raw_day)),
        check(_object(v("attestation")) & (confirmed == F.lit(False)), "CMS_V3_ATTESTATION_NOT_CONFIRMED", "conformance", "WARNING", "the attestation is explicitly not confirmed"),
        wrong(F.col("elements").isNull() & (F.col("items") + F.col("bad_items") == 0), f"ENVELOPE_{ARRAY.upper()}_MISSING", f"there is no {ARRAY} array"),
        missing(complete & (F.col("elements") >= 0) & (F.col("items") == 0), f"{ARRAY.upper()}_EMPTY", "the scan completed and saw no item"),
        check(F.col("bom"), "JSON_UTF8_BOM_PRESENT", "conformance", "INFO", "a byte-order mark was tolerated"),
        error(F.col("bad_items") > 0, "JSON_ARRAY_ITEM_PROBLEM", "conformance", "some array elements can't be used"),
        error(~complete, "JSON_STREAM_INCOMPLETE", "conformance", "the document couldn't be read to its end"),
        error(day.isNull(), "FRESHNESS_DATE_NOT_USABLE", "freshness", "there is no usable date"),
        check(day > now, "FRESHNESS_DATE_IN_FUTURE", "freshness", "WARNING", "the date is after the day of inspection"),
        check(now > F.add_months(day, 12), "FRESHNESS_ANNUAL_UPDATE_OVERDUE", "freshness", "WARNING", "the date is more than a year back"),
        check(complete & (F.col("items") > 0) & (F.col("payer_rates") == 0), "INTERPRETABILITY_NO_PAYER_RATES", "interpretability", "WARNING", "no payer rate was seen"),
        check(complete & (F.col("percentage_rates") > 0), "INTERPRETABILITY_PERCENTAGE_RATES", "interpretability", "INFO", "percentages aren't dollar amounts"),
        check(complete & (F.col("algorithm_rates") > 0), "INTERPRETABILITY_ALGORITHM_RATES", "interpretability", "INFO", "algorithms aren't dollar amounts"),
    ]
    return failing(files, checks, "file_id")


def _texts(keys: str, *names: str) -> dict[str, Column]:
    """The text of each key where it is a JSON string, as columns."""
    of = lambda n: F.col(f"{keys}.`{n}`" if keys else n)
    return {f"{keys}_{n}": F.when(F.schema_of_variant(of(n)) == "STRING", F.try_variant_get(of(n), "$", "string")) for n in names}


def _some(text: Column | str) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"(?U)\S")), F.lit(False))


def _code_checks(c: Column) -> list[Column]:
    return [missing(~_is_text(c["code"]), "CODE_VALUE_MISSING", "a code has no usable value"), missing(~_is_text(c["type"]), "CODE_TYPE_MISSING", "a code has no usable type")]


def _group_checks() -> list[Column]:
    g = lambda name: F.col(f"gs.{name}")
    is_object = F.col("gs").isNotNull()
    dollars, none = F.col("dollars"), F.coalesce("payers", F.lit(0)) <= 0
    return [
        wrong(~is_object, "CHARGE_GROUP_NOT_OBJECT", with_value("a charge group isn't an object", N.raw_group())),
        wrong(is_object & no(F.col("gs_setting").isin(SETTINGS)), "SETTING_INVALID", with_value("a setting isn't one of the accepted values", g("setting"))),
        missing(is_object & g("gross_charge").isNull() & g("discounted_cash").isNull() & none, "CHARGE_VALUE_MISSING", "a charge group has no charge of any kind"),
        wrong(is_object & none & N.usable(N.raw_payers()), "PAYERS_INFORMATION_INVALID", with_value("payers_information is neither absent, null nor a list with entries", N.raw_payers())),
        *[missing(is_object & g(f).isNull() & dollars, f"DOLLAR_RANGE_{f.upper()}_MISSING", f"a group with dollar rates has no {f}") for f in ("minimum", "maximum")],
    ]


def _payer_checks() -> list[Column]:
    p = lambda name: F.col(f"ps.`{name}`")
    text = lambda name: F.col(f"ps_{name}")
    is_object = F.col("ps").isNotNull()
    kinds = [N.present(p(f"standard_charge_{k}")) for k in ("dollar", "percentage", "algorithm")]
    derived = is_object & (kinds[1] | kinds[2])
    no_notes = ~_some(text("additional_payer_notes"))
    zero = F.coalesce(text("count") == "0", F.lit(False))
    return [
        wrong(~is_object, "PAYER_RATE_NOT_OBJECT", with_value("a payer rate isn't an object", N.raw_payer())),
        *[missing(is_object & ~_some(text(f)), f"PAYER_{f.upper()}_MISSING", f"a payer rate has no usable {f}") for f in ("payer_name", "plan_name")],
        wrong(is_object & no(text("methodology").isin(METHODOLOGIES)), "METHODOLOGY_INVALID", with_value("a methodology isn't one of the accepted values", p("methodology"))),
        missing(is_object & (text("methodology") == "other") & no_notes, "OTHER_METHODOLOGY_NOTES_MISSING", "methodology 'other' needs notes"),
        missing(is_object & ~kinds[0] & ~kinds[1] & ~kinds[2], "PAYER_CHARGE_MISSING", "a payer rate states no charge"),
        missing(derived & ~_some(text("count")), "DERIVED_RATE_COUNT_MISSING", "a derived rate has no count"),
        missing(derived & zero & no_notes, "ZERO_COUNT_NOTES_MISSING", "a derived rate with count 0 needs notes"),
        *[missing(derived & ~zero & p(f).isNull(), f"DERIVED_RATE_{f.upper()}_MISSING", f"a derived rate has no {f}") for f in ("10th_percentile", "median_amount", "90th_percentile")],
    ]


_FOUND = "array<struct<phase:int,a:int,b:int,rule:int,code:string,dimension:string,severity:string,message:string>>"


def _nothing() -> Column:
    return F.array().cast(_FOUND)


def placed(checks: list[Column], phase: int, a: Column, b: Column) -> Column:
    """The checks that fail, with their place in the item."""
    failed = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return F.transform(failed, lambda x, k: F.struct(F.lit(phase).alias("phase"), a.cast("int").alias("a"), b.cast("int").alias("b"), k.alias("rule"), x["code"].alias("code"), x["dimension"].alias("dimension"), x["severity"].alias("severity"), x["message"].alias("message"))).cast(_FOUND)


def inspect(rows: DataFrame, as_of: date) -> DataFrame:
    """Findings of every file among rows of ``charge_json`` (with a ``file_id``): code, dimension, severity, message, occurrences."""
    # keys and texts are columns of their own, worked out once; an item is checked at its first row, a group at its first payer's
    own = N.unfolded(N.items(rows))
    own = own.withColumns(_texts("", "description") | _texts("gs", "setting") | _texts("ps", "payer_name", "plan_name", "methodology", "count", "additional_payer_notes"))
    item_checks = [
        missing(~_some("_description"), "ITEM_DESCRIPTION_MISSING", "an item has no usable description"),
        missing(_size(F.col("codes")) <= 0, "ITEM_CODE_INFORMATION_MISSING", "an item has no codes"),
        missing(F.coalesce("charges", F.lit(0)) <= 0, "ITEM_STANDARD_CHARGES_MISSING", "an item has no charges"),
    ]
    none = F.lit(-1)
    found = F.concat(
        F.when(F.col("of_item"), F.concat(placed(item_checks, 0, none, none), F.coalesce(F.flatten(F.transform("codes", lambda c, k: placed(_code_checks(c), 1, k, none))), _nothing()))).otherwise(_nothing()),
        F.when(F.col("of_group"), placed(_group_checks(), 2, F.col("gk"), none)).otherwise(_nothing()), F.when(F.col("pk").isNotNull(), placed(_payer_checks(), 2, F.col("gk"), F.col("pk"))).otherwise(_nothing()),
    )
    stated = lambda kind: N.present(F.col(f"ps.standard_charge_{kind}")).alias(kind)
    light = own.select("file_id", "item_ordinal", found.alias("found"), F.col("pk").isNotNull().alias("payer"), stated("percentage"), stated("algorithm"))
    kept = sinks.scratch(rows.sparkSession, "json-findings")
    light.write.parquet(kept)
    light = rows.sparkSession.read.schema(light.schema).parquet(kept)
    rates = light.groupBy("file_id").agg(F.count(F.when(F.col("payer"), 1)).alias("payer_rates"), *[F.count(F.when(F.col(k), 1)).alias(f"{k}_rates") for k in ("percentage", "algorithm")])
    files = N.envelope(rows).join(rates, "file_id", "left").na.fill(0, ["payer_rates", "percentage_rates", "algorithm_rates"])
    of_files = file_checks(files, as_of).withColumns({"item_ordinal": F.lit(-1).cast("bigint"), "phase": F.lit(3), "a": none, "b": none})
    of_items = light.where(F.size("found") > 0).select("file_id", "item_ordinal", F.explode("found").alias("f")).select("file_id", "item_ordinal", "f.*")
    return rollup(of_files.unionByName(of_items), "file_id", position=["item_ordinal", "phase", "a", "b", "rule"])


def counters(rows: DataFrame) -> DataFrame:
    """One row per file: items, codes, charge groups, payer rates and of each kind, combinations of payer and plan, and the settings and methodologies seen.

    Sets are of the values themselves, first made different in the map tasks; other than the accepted ones count too.
    """
    own = N.unfolded(N.items(rows))
    p = lambda name: F.col(f"ps.{name}")
    stated = lambda kind: (F.col("pk").isNotNull() & N.usable(p(f"standard_charge_{kind}"))).alias(f"{kind}_rate_count")
    light = own.select(
        "file_id", F.when(F.col("of_item"), F.size("codes")).alias("code_count"), F.col("of_group").alias("charge_group_count"), F.col("pk").isNotNull().alias("payer_rate_count"), *map(stated, ("dollar", "percentage", "algorithm")),
        N.string(p("payer_name")).alias("a"), N.string(p("plan_name")).alias("b"), F.when(F.col("of_group"), N.string(F.col("gs.setting"))).alias("setting"), N.string(p("methodology")).alias("methodology"),
    )
    kept = sinks.scratch(rows.sparkSession, "json-counters")
    light.write.parquet(kept)
    light = rows.sparkSession.read.schema(light.schema).parquet(kept)
    # a negative size is that of no list
    counts = light.groupBy("file_id").agg(F.sum(F.when(F.col("code_count") > 0, F.col("code_count"))).alias("code_count"), *[F.count(F.when(F.col(c), 1)).alias(c) for c in light.columns if c.endswith("_count") and c != "code_count"])
    combos = light.select("file_id", "a", "b").where("a is not null and b is not null").distinct().groupBy("file_id").agg(F.count("*").alias("payer_plan_combination_count"))
    seen = lambda c, name: light.select("file_id", F.col(c).alias("x")).where("x is not null").distinct().groupBy("file_id").agg(F.array_sort(F.collect_list("x")).alias(name))
    out = N.envelope(rows).select("file_id", F.col("items").alias("item_count"), F.col("bad_items").alias("problem_count"))
    for part in (counts, combos, seen("setting", "settings"), seen("methodology", "methodologies")):
        out = out.join(part, "file_id", "left")
    numbers = [c for c in out.columns if c.endswith("_count")]
    return out.na.fill(0, numbers).withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("settings", "methodologies")})
