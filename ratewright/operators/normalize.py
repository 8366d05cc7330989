"""Elements of charge documents to normalized tables: nested values stay VARIANT until a typed column is taken from them.

Ids are SHA-256 of the file's id, a kind and ordinals, so that they are the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key

_NUMBERS = ["DECIMAL", "BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"]


def field(v: Column | str, path: str) -> Column:
    """Missing: null. JSON null: a variant null. Both are told apart by :func:`present` and :func:`usable`."""
    return F.try_variant_get(v, path, "variant")


def present(v: Column) -> Column:
    """The key is there, whatever its value."""
    return v.isNotNull()


def usable(v: Column) -> Column:
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def kind_of(v: Column) -> Column:
    """Lists and objects are told by a shallow cast: the schema of a whole value would walk all of it."""
    scalar = F.substring_index(F.schema_of_variant(v), "(", 1)
    return F.when(elements(v).isNotNull(), "ARRAY").when(is_object(v), "OBJECT").otherwise(scalar)


def string(v: Column) -> Column:
    """Text of a JSON string with something in it, else null; numbers and booleans aren't text."""
    value = F.try_variant_get(v, "$", "string")
    return F.when((F.schema_of_variant(v) == "STRING") & value.rlike(r"(?U)\S"), value)


def number(v: Column) -> Column:
    """A JSON number as decimal(38,10); strings and booleans aren't numbers."""
    return F.when(F.substring_index(F.schema_of_variant(v), "(", 1).isin(_NUMBERS), F.try_variant_get(v, "$", "decimal(38,10)"))


def elements(v: Column) -> Column:
    """An array's elements, or null if it isn't an array."""
    return F.try_variant_get(v, "$", "array<variant>")


def key(kind: str, *ordinals: str) -> Column:
    return F.sha2(F.concat_ws(":", "file_id", F.lit(kind), *ordinals), 256)


def items(rows: DataFrame) -> DataFrame:
    """rows of ``charge_json`` with a ``file_id``; those with a problem are left out."""
    own = rows.where("part = 'standard_charge_information' and problem is null")
    v = own.select("file_id", F.col("ordinal").alias("item_ordinal"), "payload_text", F.sha2("payload_text", 256).alias("payload_sha256"), F.try_parse_json("payload_text").alias("v"))
    return v.withColumn("item_id", key("item", "item_ordinal"))


_of = lambda *names: ",".join(f"`{n}`:variant" for n in names)
_GROUP = ("setting", "billing_class", "gross_charge", "discounted_cash", "minimum", "maximum", "modifier_code", "additional_generic_notes")
_PAYER = ("payer_name", "plan_name", "methodology", "standard_charge_dollar", "standard_charge_percentage", "standard_charge_algorithm", "count", "median_amount", "10th_percentile", "90th_percentile", "additional_payer_notes")
#: An item's keys as one cast takes them out of all levels; what isn't an object or a list is null there, other values stay VARIANT.
ITEM = f"struct<{_of('description', 'drug_information')},code_information:array<struct<{_of('code', 'type')}>>,standard_charges:array<struct<{_of(*_GROUP)},payers_information:array<struct<{_of(*_PAYER)}>>>>>"


def unfolded(items_: DataFrame) -> DataFrame:
    """A row for each payer rate, or for a group or an item without. description, drug_information, codes and charges (a size; null: no list) are the
    item's; gk and gs (null: no object) the group's, with payers (a size) and dollars (whether a payer has some); pk and ps the payer's. of_item and of_group: the row is
    the first of its item and group. raw is the item's value where a list, group or payer of it is none, for :func:`raw_group` and :func:`raw_payer`.

    Every payload is parsed once, and no row carries a list of groups or payers.
    """
    odd_group = lambda g: g.isNull() | (F.coalesce(F.size(g["payers_information"]), F.lit(0)) <= 0) | F.exists(g["payers_information"], lambda p: p.isNull())
    i = items_.select("file_id", "item_ordinal", "v", F.try_variant_get("v", "$", ITEM).alias("i"))
    lists = i.select(
        "file_id", "item_ordinal", "i.description", "i.drug_information", F.col("i.code_information").alias("codes"), F.size("i.standard_charges").alias("charges"),
        F.when(F.col("i.code_information").isNull() | F.col("i.standard_charges").isNull() | F.exists("i.code_information", lambda c: c.isNull()) | F.exists("i.standard_charges", odd_group), F.col("v")).alias("raw"), F.posexplode_outer("i.standard_charges").alias("gk", "group"),
    )
    groups_ = lists.select(
        *[c for c in lists.columns if c != "group"], F.when(F.col("group").isNotNull(), F.struct(*[F.col(f"group.{n}") for n in _GROUP])).alias("gs"), F.size("group.payers_information").alias("payers"),
        F.coalesce(F.exists("group.payers_information", lambda p: p["standard_charge_dollar"].isNotNull()), F.lit(False)).alias("dollars"), F.posexplode_outer("group.payers_information").alias("pk", "ps"),
    )
    first = F.coalesce("pk", F.lit(0)) == 0
    return groups_.withColumns({"of_item": first & (F.coalesce("gk", F.lit(0)) == 0), "of_group": first & F.col("gk").isNotNull()})


def raw_group() -> Column:
    """A group that is no object, or whose payers are none or no list or have one that is no object; of a row of :func:`unfolded`."""
    return F.try_element_at(elements(field("raw", "$.standard_charges")), F.col("gk") + 1)


def raw_payers() -> Column:
    return field(raw_group(), "$.payers_information")


def raw_payer() -> Column:
    return F.try_element_at(elements(raw_payers()), F.col("pk") + 1)


def charge_items(items_: DataFrame) -> DataFrame:
    return items_.select("file_id", "item_id", "item_ordinal", string(field("v", "$.description")).alias("description"), number(field("v", "$.drug_information.unit")).alias("drug_unit"), string(field("v", "$.drug_information.type")).alias("drug_type"))


def charge_codes(items_: DataFrame) -> DataFrame:
    e = items_.select("file_id", "item_id", "item_ordinal", F.posexplode(elements(field("v", "$.code_information"))).alias("code_ordinal", "c"))
    return e.select("file_id", "item_id", F.col("code_ordinal").cast("bigint").alias("code_ordinal"), string(field("c", "$.code")).alias("code"), string(field("c", "$.type")).alias("code_type"))


def groups(items_: DataFrame) -> DataFrame:
    """Charge groups with their variant ``g``."""
    e = items_.select("file_id", "item_id", "item_ordinal", F.posexplode(elements(field("v", "$.standard_charges"))).alias("group_ordinal", "g"))
    return e.withColumn("charge_group_id", key("charge", "item_ordinal", "group_ordinal"))


def charge_groups(groups_: DataFrame) -> DataFrame:
    g = lambda name: field("g", f"$.{name}")
    return groups_.select(
        "file_id", "charge_group_id", "item_id", F.col("group_ordinal").cast("bigint").alias("group_ordinal"), string(g("setting")).alias("setting"), string(g("billing_class")).alias("billing_class"),
        number(g("gross_charge")).alias("gross_charge"), number(g("discounted_cash")).alias("discounted_cash"), number(g("minimum")).alias("minimum_amount"), number(g("maximum")).alias("maximum_amount"), string(g("additional_generic_notes")).alias("notes"),
    )


def charge_modifiers(groups_: DataFrame) -> DataFrame:
    e = groups_.select("file_id", "charge_group_id", F.posexplode(elements(field("g", "$.modifier_code"))).alias("modifier_ordinal", "m"))
    code = string(F.col("m"))
    return e.select("file_id", "charge_group_id", F.col("modifier_ordinal").cast("bigint").alias("modifier_ordinal"), code.alias("modifier_code"), canonical_key(code).alias("canonical_modifier_code"))


def payers(groups_: DataFrame) -> DataFrame:
    e = groups_.select("file_id", "charge_group_id", "item_ordinal", "group_ordinal", F.posexplode(elements(field("g", "$.payers_information"))).alias("payer_ordinal", "p"))
    return e.withColumn("payer_rate_id", key("payer", "item_ordinal", "group_ordinal", "payer_ordinal"))


def plan_key(payer: Column, plan: Column) -> Column:
    return F.to_json(F.array(canonical_key(payer), canonical_key(plan)))


def payer_rates(payers_: DataFrame) -> DataFrame:
    p = lambda name: field("p", f'$["{name}"]')
    payer, plan = string(p("payer_name")), string(p("plan_name"))
    return payers_.select(
        "file_id", "payer_rate_id", "charge_group_id", F.col("payer_ordinal").cast("bigint").alias("payer_ordinal"), payer.alias("payer_name"), plan.alias("plan_name"), plan_key(payer, plan).alias("canonical_payer_plan_key"),
        string(p("methodology")).alias("methodology"), number(p("standard_charge_dollar")).alias("standard_charge_dollar"), number(p("standard_charge_percentage")).alias("standard_charge_percentage"), string(p("standard_charge_algorithm")).alias("standard_charge_algorithm"),
        string(p("count")).alias("allowed_count"), number(p("median_amount")).alias("median_amount"), number(p("10th_percentile")).alias("p10_amount"), number(p("90th_percentile")).alias("p90_amount"), string(p("additional_payer_notes")).alias("notes"),
    )


def payer_rates_of_groups(items_: DataFrame) -> DataFrame:
    """:func:`payer_rates` with the setting and billing_class of their group, which is in the same element: no join, and each payload is parsed once."""
    own = unfolded(items_).where("pk is not null")
    g, p = (lambda n: F.col(f"gs.`{n}`")), (lambda n: F.col(f"ps.`{n}`"))
    payer, plan = string(p("payer_name")), string(p("plan_name"))
    return own.select(
        "file_id", key("payer", "item_ordinal", "gk", "pk").alias("payer_rate_id"), key("charge", "item_ordinal", "gk").alias("charge_group_id"), F.col("pk").cast("bigint").alias("payer_ordinal"), payer.alias("payer_name"), plan.alias("plan_name"), plan_key(payer, plan).alias("canonical_payer_plan_key"),
        string(p("methodology")).alias("methodology"), number(p("standard_charge_dollar")).alias("standard_charge_dollar"), number(p("standard_charge_percentage")).alias("standard_charge_percentage"), string(p("standard_charge_algorithm")).alias("standard_charge_algorithm"),
        string(p("count")).alias("allowed_count"), number(p("median_amount")).alias("median_amount"), number(p("10th_percentile")).alias("p10_amount"), number(p("90th_percentile")).alias("p90_amount"), string(p("additional_payer_notes")).alias("notes"),
        string(g("setting")).alias("setting"), string(g("billing_class")).alias("billing_class"),
    )


def modifiers(rows: DataFrame) -> DataFrame:
    own = rows.where("part = 'modifier_information' and problem is null").select("file_id", F.col("ordinal").alias("modifier_ordinal"), "payload_text", F.sha2("payload_text", 256).alias("payload_sha256"), F.try_parse_json("payload_text").alias("v"))
    code = string(field("v", "$.code"))
    return own.select("file_id", key("modifier", "modifier_ordinal").alias("modifier_id"), "modifier_ordinal", "payload_text", "payload_sha256", string(field("v", "$.description")).alias("description"), code.alias("code"), canonical_key(code).alias("canonical_code"), string(field("v", "$.setting")).alias("setting"), "v")


def modifier_payers(modifiers_: DataFrame) -> DataFrame:
    e = modifiers_.select("file_id", "modifier_id", "modifier_ordinal", F.posexplode(elements(field("v", "$.modifier_payer_information"))).alias("payer_ordinal", "p"))
    payer, plan = string(field("p", "$.payer_name")), string(field("p", "$.plan_name"))
    return e.select("file_id", key("modifier-payer", "modifier_ordinal", "payer_ordinal").alias("modifier_payer_id"), "modifier_id", payer.alias("payer_name"), plan.alias("plan_name"), plan_key(payer, plan).alias("canonical_payer_plan_key"), string(field("p", "$.description")).alias("description"))


def envelope(rows: DataFrame) -> DataFrame:
    """One row per file: the top-level fields as a map of variants, and what the scan came to."""
    fields = F.map_from_entries(F.collect_list(F.when(F.col("part") == "envelope", F.struct("name", "payload_text"))))
    ends = F.max(F.when((F.col("part") == "end") & (F.col("name") == "standard_charge_information"), F.col("ordinal")))
    # the texts of elements don't go where rows are sorted by file
    light = rows.select("file_id", "part", "name", "ordinal", "problem", "bom", F.when(F.col("part").isin("envelope", "source"), F.col("payload_text")).alias("payload_text"))
    return light.groupBy("file_id").agg(
        fields.alias("fields"), ends.alias("elements"), F.max("bom").alias("bom"), F.min(F.when(F.col("part") == "stream", F.col("problem"))).alias("broken"),
        F.count(F.when(F.col("part") == "standard_charge_information", F.col("problem"))).alias("bad_items"),
        F.count(F.when((F.col("part") == "standard_charge_information") & F.col("problem").isNull(), 1)).alias("items"),
        F.max(F.when(F.col("part") == "source", F.col("payload_text"))).alias("source_sha256"), F.max(F.when(F.col("part") == "source", F.col("ordinal"))).alias("source_size"),
    )


def by_content(rows: DataFrame) -> DataFrame:
    """rows of ``charge_json`` with a ``file_id`` that is the SHA-256 of the file's bytes: equal files are one file."""
    return rows.join(rows.where("part = 'source'").groupBy("file").agg(F.max("payload_text").alias("file_id")), "file")


PROBLEM_SAMPLES, PROBLEM_LENGTH = 100, 300


def problems(rows: DataFrame, most: int = PROBLEM_SAMPLES) -> DataFrame:
    """file_id, problem_count (exact) and problem_samples: the first ``most`` elements that can't be used, as structs of part, ordinal and problem.

    Only the first ``most`` of a file reach the task that lists them: a window keeps them in each partition first.
    """
    bad = rows.where("problem is not null and part <> 'stream'").select("file_id", "part", "ordinal", F.substring("problem", 1, PROBLEM_LENGTH).alias("problem"))
    counts = bad.groupBy("file_id").agg(F.count("*").alias("problem_count"))
    order = F.row_number().over(Window.partitionBy("file_id").orderBy("part", "ordinal"))
    first = bad.withColumn("k", order).where(F.col("k") <= most).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("part", "ordinal", "problem"))).alias("problem_samples"))
    return counts.join(first, "file_id")


class WrongType(ValueError):
    """Values of another JSON type than the model's; the message has each place and its count."""


_TEXT, _NUMBER, _LIST, _OBJECT = "text", "number", "list", "object"


_WRONG = "array<struct<place:string,expected:string,found:string>>"


def _right(have: Column, kind: str) -> Column:
    return {_TEXT: have == "STRING", _NUMBER: have.isin(_NUMBERS), _LIST: have == "ARRAY", _OBJECT: have == "OBJECT"}[kind]


def _wrong(checks: list[tuple[str, str, Column]]) -> list[Column]:
    """Values that are there, aren't null, and aren't of the kind."""
    return [F.when(usable(v) & ~F.coalesce(_right(kind_of(v), kind), F.lit(False)), F.struct(F.lit(place).alias("place"), F.lit(kind).alias("expected"), kind_of(v).alias("found"))) for place, kind, v in checks]


def type_errors(rows: DataFrame) -> DataFrame:
    """file_id, place (like ``payer.methodology``), expected, found and the number of values that the typed tables would lose as nulls."""
    m = modifiers(rows)
    own = unfolded(items(rows))
    at = lambda keys, names, level: [(f"{level}.{n}", k, kind_of(keys(n))) for n, k in names.items()]
    of = lambda c: lambda n: F.col(f"{c}.`{n}`" if c else n)
    other = lambda there, kind, raw: F.when(there, kind).otherwise(kind_of(raw))  # the one cast told most kinds already
    item = [*at(of(""), {"description": _TEXT, "drug_information": _OBJECT}, "item"), ("item.code_information", _LIST, other(F.col("codes").isNotNull(), "ARRAY", field("raw", "$.code_information"))), ("item.standard_charges", _LIST, other(F.col("charges") >= 0, "ARRAY", field("raw", "$.standard_charges")))]
    group = [("charge", _OBJECT, other(F.col("gs").isNotNull(), "OBJECT", raw_group())), ("charge.payers_information", _LIST, other(F.col("payers") >= 0, "ARRAY", raw_payers()))]
    group += at(of("gs"), {"setting": _TEXT, "billing_class": _TEXT, "gross_charge": _NUMBER, "discounted_cash": _NUMBER, "minimum": _NUMBER, "maximum": _NUMBER, "modifier_code": _LIST, "additional_generic_notes": _TEXT}, "charge")
    payer = [("payer", _OBJECT, other(F.col("ps").isNotNull(), "OBJECT", raw_payer())), *at(of("ps"), {"payer_name": _TEXT, "plan_name": _TEXT, "methodology": _TEXT, "standard_charge_dollar": _NUMBER, "standard_charge_percentage": _NUMBER, "standard_charge_algorithm": _TEXT, "count": _TEXT, "median_amount": _NUMBER, "10th_percentile": _NUMBER, "90th_percentile": _NUMBER, "additional_payer_notes": _TEXT}, "payer")]
    # kinds are columns of their own, worked out once; what is wrong is then told by them alone. VOID is the kind of a null
    levels = [(F.col("of_item"), item), (F.col("of_group"), group), (F.col("pk").isNotNull(), payer)]
    kinds = [F.nullif(F.when(first, kind), F.lit("VOID")).alias(f"k_{place}") for first, checks in levels for place, _, kind in checks]
    light = own.select("file_id", "of_item", "codes", "raw", *kinds)
    wrong = [F.when(~_right(F.col(f"`k_{place}`"), kind), F.struct(F.lit(place).alias("place"), F.lit(kind).alias("expected"), F.col(f"`k_{place}`").alias("found"))) for _, checks in levels for place, kind, _ in checks]
    raw_code = lambda k: F.try_element_at(elements(field("raw", "$.code_information")), k + 1)
    in_code = lambda c, k: F.array(*_wrong([("code", _OBJECT, F.when(c.isNull(), raw_code(k))), ("code.code", _TEXT, c["code"]), ("code.type", _TEXT, c["type"])]))
    of_codes = F.flatten(F.transform(F.when(F.col("of_item"), F.col("codes")), in_code))
    every = F.filter(F.concat(F.array(*wrong), F.coalesce(of_codes, F.array().cast(_WRONG))), lambda x: x.isNotNull())
    of_modifiers = F.filter(F.array(*_wrong([(f"modifier.{n}", k, field("v", f"$.{n}")) for n, k in {"description": _TEXT, "code": _TEXT, "setting": _TEXT, "modifier_payer_information": _LIST}.items()])), lambda x: x.isNotNull())
    out = light.select("file_id", F.inline(every)).unionByName(m.select("file_id", F.inline(of_modifiers)))
    return out.groupBy("file_id", "place", "expected", "found").agg(F.count("*").alias("values"))


def require_types(rows: DataFrame) -> None:
    bad = type_errors(rows).groupBy("place", "expected", "found").agg(F.sum("values").alias("n")).orderBy("place", "found").collect()  # places times types
    if bad:
        raise WrongType("; ".join(f"{r.place} is {r.found}, not {r.expected}: {r.n}" for r in bad))


class LoadRefused(ValueError):
    """A file's envelope lacks what a load needs; the message says which files and why."""


def load_refusals(envelopes: DataFrame, version: str, needed: tuple[str, ...]) -> DataFrame:
    """Of :func:`envelope`: the files that can't be loaded, with the first reason: a needed field is missing, blank text, another version, no ISO date."""
    v = lambda name: F.try_parse_json(F.try_element_at("fields", F.lit(name)))
    text = lambda name: string(v(name))
    missing = F.filter(F.array(*[F.when(F.try_element_at("fields", F.lit(n)).isNull(), F.lit(n)) for n in needed]), lambda x: x.isNotNull())
    day = F.when(text("last_updated_on").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text("last_updated_on"), "yyyy-MM-dd"))
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
        .when(text("hospital_name").isNull() | text("last_updated_on").isNull() | text("version").isNull(), "name, date or version isn't text")
        .when(text("version") != version, F.concat(F.lit("another template version: "), text("version")))
        .when(day.isNull(), F.concat(F.lit("not an ISO date: "), text("last_updated_on")))
    )
    return envelopes.select("file_id", reason.alias("reason"), text("version").alias("observed_version"), day.alias("period")).where(F.col("reason").isNotNull())


def require_loadable(envelopes: DataFrame, version: str, needed: tuple[str, ...]) -> None:
    bad = load_refusals(envelopes, version, needed).groupBy("reason").agg(F.count("*").alias("n"), F.min("file_id").alias("first")).orderBy("reason").limit(20).collect()
    if bad:
        raise LoadRefused("; ".join(f"{r.reason} ({r.n} files, such as {r.first})" for r in bad))


def normalize(rows: DataFrame) -> dict[str, DataFrame]:
    """All tables of the model, from one read of the source; ``rows`` should be cached or stored by the caller."""
    i = items(rows)
    g = groups(i)
    p = payers(g)
    m = modifiers(rows)
    return {
        "raw_item": i.select("file_id", "item_ordinal", "payload_text", "payload_sha256"),
        "charge_item": charge_items(i), "charge_code": charge_codes(i), "charge_group": charge_groups(g), "charge_modifier": charge_modifiers(g), "payer_rate": payer_rates(p),
        "raw_modifier": m.select("file_id", "modifier_ordinal", "payload_text", "payload_sha256"), "modifier": m.drop("v", "payload_text", "payload_sha256"), "modifier_payer": modifier_payers(m),
    }
