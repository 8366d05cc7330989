"""Charge documents with one known fault each, made of the suppliers and line items, and what an inspection must say of them.

Every supplier has a document and every line item an item (JSON) or a row (CSV) in it. The fault of a document follows from the supplier's
key, that of an item from the line's keys, so the SQL of the expected findings counts keys and knows nothing of documents.
"""

from __future__ import annotations

import copy
import csv
import io
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sinks

Finding = tuple[str, str, str]  # code, dimension, severity
#: Faults of items and rows follow from this remainder, those of documents from the supplier's key by DOCUMENTS.
ITEMS, DOCUMENTS = 40, 50
ITEM_FAULT = f"(l_orderkey * 7 + l_linenumber) % {ITEMS}"


def _of(dimension: str, *codes: str, severity: str = "ERROR") -> list[Finding]:
    return [(c, dimension, severity) for c in codes]


def _picked(numbers: Column, values: dict[int, str]) -> Column:
    """The text for a number; the one of 0 for all others."""
    at = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(at, numbers.cast("int")), F.lit(values[0]))


# --- JSON --------------------------------------------------------------------------------------------------------

_ITEM = {"description": "line @", "code_information": [{"code": "7001", "type": "CPT"}], "standard_charges": [{"setting": "outpatient", "gross_charge": 44.5, "minimum": 7, "maximum": 31, "payers_information": [{"payer_name": "North Mutual", "plan_name": "Basic", "methodology": "case rate", "standard_charge_dollar": 21}]}]}
_DERIVED = {"standard_charge_dollar": None, "standard_charge_percentage": 35, "count": "14", "10th_percentile": 6, "median_amount": 9, "90th_percentile": 12}


def _changed(change: Callable[[dict, dict, dict], object]) -> str:
    item = copy.deepcopy(_ITEM)
    group = item["standard_charges"][0]
    payer = group["payers_information"][0]
    out = change(item, group, payer)
    return json.dumps(item if out is None else out)


def _derived(**more: object) -> Callable:
    def change(item, group, payer):
        payer.update(_DERIVED | more)
        for k in [k for k, v in payer.items() if v is None]:
            del payer[k]

    return change


_COMPLETE, _CONFORM = "completeness", "conformance"
JSON_ITEMS: dict[int, tuple[Callable, list[Finding]]] = {
    1: (lambda i, g, p: i.update(description="  "), _of(_COMPLETE, "CMS_V3_ITEM_DESCRIPTION_MISSING")),
    2: (lambda i, g, p: i.update(code_information=[]), _of(_COMPLETE, "CMS_V3_ITEM_CODE_INFORMATION_MISSING")),
    3: (lambda i, g, p: i.pop("standard_charges") and None, _of(_COMPLETE, "CMS_V3_ITEM_STANDARD_CHARGES_MISSING")),
    4: (lambda i, g, p: i["code_information"][0].update(code=None), _of(_COMPLETE, "CMS_V3_CODE_VALUE_MISSING")),
    5: (lambda i, g, p: i["code_information"][0].update(type=4), _of(_COMPLETE, "CMS_V3_CODE_TYPE_MISSING")),
    6: (lambda i, g, p: i.update(standard_charges=["none"]), _of(_CONFORM, "CMS_V3_CHARGE_GROUP_NOT_OBJECT")),
    7: (lambda i, g, p: g.update(setting="telehealth"), _of(_CONFORM, "CMS_V3_SETTING_INVALID")),
    8: (lambda i, g, p: i.update(standard_charges=[{"setting": "both"}]), _of(_COMPLETE, "CMS_V3_CHARGE_VALUE_MISSING")),
    9: (lambda i, g, p: g.update(payers_information=[]), _of(_CONFORM, "CMS_V3_PAYERS_INFORMATION_INVALID")),
    10: (lambda i, g, p: g.pop("minimum") and None, _of(_COMPLETE, "CMS_V3_DOLLAR_RANGE_MINIMUM_MISSING")),
    11: (lambda i, g, p: g.pop("maximum") and None, _of(_COMPLETE, "CMS_V3_DOLLAR_RANGE_MAXIMUM_MISSING")),
    12: (lambda i, g, p: g.update(payers_information=[5]), _of(_CONFORM, "CMS_V3_PAYER_RATE_NOT_OBJECT")),
    13: (lambda i, g, p: p.update(payer_name=""), _of(_COMPLETE, "CMS_V3_PAYER_PAYER_NAME_MISSING")),
    14: (lambda i, g, p: p.pop("plan_name") and None, _of(_COMPLETE, "CMS_V3_PAYER_PLAN_NAME_MISSING")),
    15: (lambda i, g, p: p.update(methodology="barter"), _of(_CONFORM, "CMS_V3_METHODOLOGY_INVALID")),
    16: (lambda i, g, p: p.update(methodology="other"), _of(_COMPLETE, "CMS_V3_OTHER_METHODOLOGY_NOTES_MISSING")),
    17: (lambda i, g, p: p.pop("standard_charge_dollar") and None, _of(_COMPLETE, "CMS_V3_PAYER_CHARGE_MISSING")),
    18: (_derived(count=None), _of(_COMPLETE, "CMS_V3_DERIVED_RATE_COUNT_MISSING")),
    19: (_derived(count="0"), _of(_COMPLETE, "CMS_V3_ZERO_COUNT_NOTES_MISSING")),
    20: (_derived(**{"10th_percentile": None}), _of(_COMPLETE, "CMS_V3_DERIVED_RATE_10TH_PERCENTILE_MISSING")),
    21: (_derived(median_amount=None), _of(_COMPLETE, "CMS_V3_DERIVED_RATE_MEDIAN_AMOUNT_MISSING")),
    22: (_derived(**{"90th_percentile": None}), _of(_COMPLETE, "CMS_V3_DERIVED_RATE_90TH_PERCENTILE_MISSING")),
    23: (lambda i, g, p: [1, 2], []),
    24: (_derived(), []),
    25: (_derived(standard_charge_percentage=None, standard_charge_algorithm="half of it"), []),
}
_BAD, _PERCENTAGES, _ALGORITHMS = (23,), (18, 19, 20, 21, 22, 24), (25,)

_ENVELOPE = {"hospital_name": "Lakeside Clinic", "last_updated_on": "2026-03-15", "version": "3.0.0", "location_name": ["Lakeside"], "hospital_address": ["9 Quay Road"], "type_2_npi": ["1770000009"], "license_information": {"state": "OR"}, "attestation": {"attestation": "complete", "confirm_attestation": True, "attester_name": "R. Vale"}}
AS_OF = "2026-08-09"
FIELDS = list(_ENVELOPE)
#: Documents without items, without payers, and broken ones.
_NO_ITEMS, _NO_PAYERS, _BROKEN = (12, 13), 18, 15


def _heads() -> dict[int, str]:
    def head(change=lambda e: None, before: str = "", array: str = ', "standard_charge_information": [\n') -> str:
        e = copy.deepcopy(_ENVELOPE)
        change(e)
        return before + json.dumps(e)[:-1] + array

    out = {0: head()} | {k: head(lambda e, f=f: e.pop(f)) for k, f in enumerate(FIELDS, 1)}
    return out | {
        9: head(lambda e: e.update(version="2.2.1")), 10: head(lambda e: e.update(last_updated_on="March 2026")), 11: head(lambda e: e["attestation"].update(confirm_attestation=False)), 12: head(array=""), 14: head(before="﻿"),
        16: head(lambda e: e.update(last_updated_on="2027-01-01")), 17: head(lambda e: e.update(last_updated_on="2025-08-08")),
    }


_STALE, _SOON = _of("freshness", "FRESHNESS_ANNUAL_UPDATE_OVERDUE", severity="WARNING"), _of("freshness", "FRESHNESS_DATE_IN_FUTURE", severity="WARNING")
_NO_DAY = _of("freshness", "FRESHNESS_DATE_NOT_USABLE")
JSON_DOCUMENTS: dict[int, list[Finding]] = {k: _of(_CONFORM, f"CMS_V3_ENVELOPE_{f.upper()}_MISSING") + (_NO_DAY if f == "last_updated_on" else []) for k, f in enumerate(FIELDS, 1)} | {
    9: _of(_CONFORM, "CMS_V3_VERSION_UNEXPECTED"), 10: _of(_CONFORM, "CMS_V3_LAST_UPDATED_ON_INVALID") + _NO_DAY, 11: _of(_CONFORM, "CMS_V3_ATTESTATION_NOT_CONFIRMED", severity="WARNING"),
    12: _of(_CONFORM, "CMS_V3_ENVELOPE_STANDARD_CHARGE_INFORMATION_MISSING"), 13: _of(_COMPLETE, "CMS_V3_STANDARD_CHARGE_INFORMATION_EMPTY"), 14: _of(_CONFORM, "JSON_UTF8_BOM_PRESENT", severity="INFO"),
    15: _of(_CONFORM, "JSON_STREAM_INCOMPLETE"), 16: _SOON, 17: _STALE, 18: _of("interpretability", "INTERPRETABILITY_NO_PAYER_RATES", severity="WARNING"),
}


def _texts(lines: DataFrame, text: Column) -> DataFrame:
    """``name`` (the supplier's key), ``frame`` (its document's fault) and ``text`` of each line, suppliers together. Only keys are shuffled and sorted; texts are made of them afterwards."""
    keys = lines.select("l_suppkey", "l_orderkey", "l_linenumber").repartition("l_suppkey").sortWithinPartitions("l_suppkey", "l_orderkey", "l_linenumber")
    made = F.replace(text, F.lit("@"), F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return keys.withColumn("frame", (F.col("l_suppkey") % DOCUMENTS).cast("int")).select(F.col("l_suppkey").cast("string").alias("name"), "frame", made.alias("text"))


def json_texts(lines: DataFrame) -> DataFrame:
    """The items of the documents, by supplier."""
    texts = {0: json.dumps(_ITEM)} | {k: _changed(change) for k, (change, _) in JSON_ITEMS.items()}
    plain = _changed(lambda i, g, p: g.pop("payers_information") and None)
    item = F.when(F.col("frame") == _NO_PAYERS, plain).otherwise(_picked(F.expr(ITEM_FAULT), texts))
    return _texts(lines, F.when(~F.col("frame").isin(*_NO_ITEMS), item))


def json_frames() -> dict[int, sinks.Frame]:
    """What is around the items of a document, by its fault."""
    heads = _heads()
    return {k: (heads.get(k, heads[0]), {12: "}", _BROKEN: "]"}.get(k, "]}") + "\n", "utf-8") for k in range(DOCUMENTS)}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def without_faulty_items() -> str:
    """Documents whose items have no faults."""
    return ", ".join(map(str, (*_NO_ITEMS, _NO_PAYERS)))


def json_sql() -> str:
    items = [(k, *f) for k, (_, found) in JSON_ITEMS.items() for f in found]
    documents = [(k, *f) for k, found in JSON_DOCUMENTS.items() for f in found]
    several = [(k, "JSON_ARRAY_ITEM_PROBLEM", _CONFORM, "ERROR", 0) for k in _BAD] + [(k, "INTERPRETABILITY_PERCENTAGE_RATES", "interpretability", "INFO", 1) for k in _PERCENTAGES] + [(k, "INTERPRETABILITY_ALGORITHM_RATES", "interpretability", "INFO", 1) for k in _ALGORITHMS]
    without = without_faulty_items()
    return f"""WITH l AS (SELECT l_suppkey AS supplier, l_suppkey % {DOCUMENTS} AS e, {ITEM_FAULT} AS f FROM {{lineitem}})
    SELECT supplier, code, dimension, severity, count(*) AS occurrences FROM l JOIN (VALUES {_values(items)}) x(k, code, dimension, severity) ON f = k WHERE e NOT IN ({without}) GROUP BY ALL
    UNION ALL SELECT DISTINCT supplier, code, dimension, severity, 1 FROM l JOIN (VALUES {_values(several)}) x(k, code, dimension, severity, whole) ON f = k WHERE e NOT IN ({without}) AND NOT (whole = 1 AND e = {_BROKEN})
    UNION ALL SELECT DISTINCT supplier, code, dimension, severity, 1 FROM l JOIN (VALUES {_values(documents)}) x(k, code, dimension, severity) ON e = k"""


_LINES = f"SELECT l_suppkey AS supplier, l_suppkey % {DOCUMENTS} AS e, {ITEM_FAULT} AS f FROM {{lineitem}}"
#: What an item of each fault lacks of the one code, charge group and payer (with a dollar) that others have.
_NO_CODE, _NO_GROUP, _NO_PAYER, _NO_DOLLAR, _NO_METHOD, _NO_SETTING = (2,), (3,), (3, 6, 8, 9), (3, 6, 8, 9, 12, 17, *_PERCENTAGES, *_ALGORITHMS), (12,), (6,)


def _in(numbers: tuple[int, ...]) -> str:
    return f"f IN ({', '.join(map(str, numbers))})"


def json_counts_sql() -> str:
    n = lambda test: f"count(CASE WHEN {test} THEN 1 END)"
    good, paid = f"NOT {_in(_BAD)}", f"NOT {_in((*_BAD, *_NO_PAYER))} AND e <> {_NO_PAYERS}"
    plain = f"e = {_NO_PAYERS}"
    setting = f"CASE WHEN {plain} THEN 'outpatient' WHEN {_in((*_NO_GROUP, *_NO_SETTING, *_BAD))} THEN NULL WHEN f = 7 THEN 'telehealth' WHEN f = 8 THEN 'both' ELSE 'outpatient' END"
    method = f"CASE WHEN {plain} OR {_in((*_BAD, *_NO_PAYER, *_NO_METHOD))} THEN NULL WHEN f = 15 THEN 'barter' WHEN f = 16 THEN 'other' ELSE 'case rate' END"
    listed = lambda x: f"coalesce(string_agg(DISTINCT {x}, ',' ORDER BY {x}), '')"
    # items are all there are in documents without payers, whose items have no fault
    return f"""WITH l AS ({_LINES}), d AS (SELECT *, CASE WHEN e IN ({', '.join(map(str, _NO_ITEMS))}) THEN false ELSE true END AS has FROM l)
    SELECT supplier, {n(f"has AND ({plain} OR {good})")} AS item_count, {n(f"has AND NOT {plain} AND NOT ({good})")} AS problem_count, {n(f"has AND ({plain} OR ({good} AND NOT {_in(_NO_CODE)}))")} AS code_count, {n(f"has AND ({plain} OR ({good} AND NOT {_in(_NO_GROUP)}))")} AS charge_group_count,
      {n(f"has AND {paid}")} AS payer_rate_count, {n(f"has AND {paid} AND NOT {_in(_NO_DOLLAR)}")} AS dollar_rate_count, {n(f"has AND {paid} AND {_in(_PERCENTAGES)}")} AS percentage_rate_count, {n(f"has AND {paid} AND {_in(_ALGORITHMS)}")} AS algorithm_rate_count,
      CASE WHEN {n(f"has AND {paid} AND NOT {_in((12, 13, 14))}")} > 0 THEN 1 ELSE 0 END AS payer_plan_combination_count, {listed(f"CASE WHEN has THEN {setting} END")} AS settings, {listed(f"CASE WHEN has THEN {method} END")} AS methodologies
    FROM d GROUP BY supplier"""


def _bad_items() -> str:
    return f"e NOT IN ({', '.join(map(str, (*_NO_ITEMS, _NO_PAYERS)))})"


def json_problems_sql() -> str:
    return f"WITH l AS ({_LINES}) SELECT supplier, count(*) AS problem_count, least(count(*), 3) AS samples, 'not an object' AS problems FROM l WHERE {_in(_BAD)} AND {_bad_items()} GROUP BY supplier"


def json_types_sql() -> str:
    wrong = [(5, "code.type", "text", "BIGINT"), (6, "charge", "object", "STRING"), (12, "payer", "object", "BIGINT")]
    return f"WITH l AS ({_LINES}) SELECT supplier, place, expected, found, count(*) AS values FROM l JOIN (VALUES {_values(wrong)}) x(k, place, expected, found) ON f = k WHERE {_bad_items()} GROUP BY ALL"


def json_refusals_sql() -> str:
    why = [(k, f"missing fields: {f}") for k, f in enumerate(FIELDS, 1)] + [(9, "another template version: 2.2.1"), (10, "not an ISO date: March 2026")]
    return f"WITH l AS ({_LINES}) SELECT DISTINCT supplier, reason FROM l JOIN (VALUES {_values(why)}) x(k, reason) ON e = k"


def json_peek_sql() -> str:
    return f"WITH l AS ({_LINES}) SELECT DISTINCT supplier, {len(FIELDS)} - CASE WHEN e BETWEEN 1 AND {len(FIELDS)} THEN 1 ELSE 0 END AS fields, CASE WHEN e = {FIELDS.index('version') + 1} THEN NULL WHEN e = 9 THEN '2.2.1' ELSE '3.0.0' END AS version FROM l"


# --- CSV ---------------------------------------------------------------------------------------------------------

_ATTEST = "To the best of its knowledge and belief, this hospital has included all applicable standard charge information"
_GENERAL = {"hospital_name": "Lakeside Clinic", "last_updated_on": "2026-03-15", "version": "3.0.0", "location_name": "Lakeside", "hospital_address": "9 Quay Road", "license_number|OR": "77", "type_2_npi": "1770000009", _ATTEST: "true", "attester_name": "R. Vale"}
_TALL_ROW = {
    "description": "line @", "code|1": "7001", "code|1|type": "CPT", "code|2": "", "code|2|type": "", "modifiers": "", "setting": "outpatient", "drug_unit_of_measurement": "", "drug_type_of_measurement": "", "standard_charge|gross": "44.5", "standard_charge|discounted_cash": "40",
    "payer_name": "North Mutual", "plan_name": "Basic", "standard_charge|negotiated_dollar": "21", "standard_charge|negotiated_percentage": "", "standard_charge|negotiated_algorithm": "", "median_amount": "", "10th_percentile": "", "90th_percentile": "", "count": "",
    "standard_charge|methodology": "case rate", "standard_charge|min": "7", "standard_charge|max": "31", "additional_generic_notes": "",
}
_PAYER = ["standard_charge|negotiated_dollar", "standard_charge|negotiated_percentage", "standard_charge|negotiated_algorithm", "standard_charge|methodology", "median_amount", "10th_percentile", "90th_percentile", "count", "additional_payer_notes"]
_TALL_ONLY = ["payer_name", "plan_name"]
_P = {"dollar": "standard_charge|negotiated_dollar", "percentage": "standard_charge|negotiated_percentage", "algorithm": "standard_charge|negotiated_algorithm", "p10": "10th_percentile", "median": "median_amount", "p90": "90th_percentile", "method": "standard_charge|methodology"}
_SHARE = {_P["dollar"]: "", _P["percentage"]: "35", _P["p10"]: "6", _P["median"]: "9", _P["p90"]: "12", "count": "14"}
_NOBODY = {_P["dollar"]: "", _P["method"]: "", "payer_name": "", "plan_name": ""}
_csv = lambda dimension, *codes: _of(dimension, *(f"CMS_CSV_{c}" for c in codes))
CSV_ROWS: dict[int, tuple[dict[str, str], list[Finding]]] = {
    1: ({"+": "beyond"}, _csv(_CONFORM, "ROW_WIDTH_MISMATCH")),
    2: ({"setting": "telehealth"}, _csv(_CONFORM, "SETTING_INVALID")),
    3: ({"setting": " "}, _csv(_CONFORM, "SETTING_INVALID")),
    4: ({"drug_unit_of_measurement": "3", "drug_type_of_measurement": "XX"}, _csv(_CONFORM, "DRUG_TYPE_INVALID")),
    5: ({"code|2": "7002"}, _csv(_COMPLETE, "CODE_TYPE_UNPAIRED")),
    6: ({"code|1": "", "code|1|type": ""}, _csv(_COMPLETE, "CODE_PAIRING_MISSING")),
    7: ({"description": ""}, _csv(_COMPLETE, "DESCRIPTION_MISSING")),
    8: (_NOBODY | {"standard_charge|gross": "", "standard_charge|discounted_cash": ""}, _csv(_COMPLETE, "CHARGE_VALUE_MISSING")),
    9: (_NOBODY | {"code|1": "", "code|1|type": "", "modifiers": "QX", "standard_charge|gross": "", "standard_charge|discounted_cash": ""}, _csv(_COMPLETE, "MODIFIER_ROW_CONTEXT_MISSING")),
    10: ({"standard_charge|min": ""}, _csv(_COMPLETE, "DOLLAR_RANGE_MISSING")),
    11: ({"drug_unit_of_measurement": "3"}, _csv(_COMPLETE, "DRUG_FIELDS_UNPAIRED")),
    12: ({"code|2": "00777000101", "code|2|type": "NDC"}, _csv(_COMPLETE, "NDC_DRUG_FIELDS_MISSING")),
    13: ({_P["method"]: ""}, _csv(_COMPLETE, "PAYER_CONTEXT_MISSING")),
    14: (_NOBODY | {"payer_name": "North Mutual"}, _csv(_COMPLETE, "PAYER_WITHOUT_CHARGE")),
    15: ({_P["method"]: "other"}, _csv(_COMPLETE, "OTHER_METHODOLOGY_NOTES_MISSING")),
    16: (_SHARE | {"count": ""}, _csv(_COMPLETE, "DERIVED_RATE_COUNT_MISSING")),
    17: (_SHARE | {_P["median"]: ""}, _csv(_COMPLETE, "DERIVED_RATE_PERCENTILES_MISSING")),
    18: (_SHARE | {"count": "0"}, _csv(_COMPLETE, "ZERO_COUNT_NOTES_MISSING")),
    19: ({"count": "7"}, _csv(_CONFORM, "COUNT_VALUE_INVALID")),
    20: ({_P["method"]: "barter"}, _csv(_CONFORM, "METHODOLOGY_INVALID")),
    21: ({"code|1|type": "LOKAL"}, _csv(_CONFORM, "CODE_TYPE_INVALID")),
    22: ({"standard_charge|gross": "-1"}, _csv(_CONFORM, "NUMERIC_VALUE_INVALID")),
    23: (_SHARE, []),
    24: ({_P["dollar"]: "", _P["algorithm"]: "half of it", _P["p10"]: "6", _P["median"]: "9", _P["p90"]: "12", "count": "14"}, []),
}
#: Faults that only a Tall table can have.
_ONLY_TALL = (14,)
_CSV_PERCENTAGES, _CSV_ALGORITHMS = (16, 17, 18, 23), (24,)
#: Wide documents; those of tables without rows; of rows without payers; and what each document's fault is.
_WIDES, _PAYERLESS = (0, 44, 46, 47, 48), 45
#: A document in Latin-1, and one that breaks off at a cell that is too long.
_LATIN, _CSV_BROKEN = 41, 42
CELL_BYTES = 100_000
_TALL_COLUMNS = [c for c in _TALL_ROW if not c.startswith("code|")]
_COLUMNS = list(enumerate(_TALL_COLUMNS, 10))
_ROWLESS = (*(k for k, _ in _COLUMNS), 36, 37, 38, 39, 43, 44)
_GENERALS = ["hospital_name", "last_updated_on", "version", "location_name", "hospital_address", "license_number|OR", "type_2_npi", _ATTEST, "attester_name"]
_UNDATED = _of("freshness", "CSV_FRESHNESS_DATE_NOT_USABLE")
_EMPTY = _csv(_COMPLETE, "TABLE_EMPTY")


def _column_code(name: str) -> str:
    return f"COLUMN_{name.removeprefix('standard_charge|').upper().replace('|', '_')}_MISSING"


CSV_DOCUMENTS: dict[int, list[Finding]] = (
    {k: _csv(_CONFORM, f"GENERAL_{'ATTESTATION' if n == _ATTEST else n.split('|')[0].upper()}_MISSING") + (_UNDATED if n == "last_updated_on" else []) for k, n in enumerate(_GENERALS, 1)}
    | {k: _csv(_CONFORM, _column_code(n)) + _EMPTY for k, n in _COLUMNS}
    | {
        30: _csv(_CONFORM, "VERSION_UNEXPECTED"), 31: _csv(_CONFORM, "LAST_UPDATED_ON_INVALID") + _UNDATED, 32: _csv(_CONFORM, "PLACEHOLDER_NOT_REPLACED", "GENERAL_LICENSE_NUMBER_MISSING"), 33: _of(_CONFORM, "CMS_CSV_ATTESTATION_NOT_CONFIRMED", severity="WARNING"),
        34: _of(_CONFORM, "CMS_CSV_UTF8_BOM_PRESENT", severity="INFO"), 35: _SOON, 36: _csv(_CONFORM, "COLUMN_CODE_PAIR_MISSING") + _EMPTY, 37: _csv(_CONFORM, "CHARGE_HEADER_ROW_MISSING"), 38: _csv(_CONFORM, "LAYOUT_AMBIGUOUS") + _EMPTY, 39: _csv(_CONFORM, "PLACEHOLDER_NOT_REPLACED") + _EMPTY,
        40: _STALE, _LATIN: _of(_CONFORM, "CMS_CSV_ENCODING_NOT_UTF8", severity="INFO"), _CSV_BROKEN: _csv(_CONFORM, "STREAM_INCOMPLETE"), 43: _csv(_CONFORM, "HEADER_NOT_UNIQUE") + _EMPTY, 44: _csv(_CONFORM, "WIDE_PAYER_HEADER_SET_INCOMPLETE") + _EMPTY, 45: _of("interpretability", "CSV_INTERPRETABILITY_NO_PAYER_RATES", severity="WARNING"),
    }
)


def _line(cells: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


def _wide(name: str) -> str:
    if name not in _PAYER:
        return name
    return f"standard_charge|North Mutual|Basic|{name.split('|')[1]}" if name.startswith("standard_charge|") else f"{name}|North Mutual|Basic" if name == "additional_payer_notes" else f"{name}|North Mutual|Basic"


def _row(change: dict[str, str], wide: bool) -> str:
    cells = _TALL_ROW | {"additional_payer_notes": ""} | {k: v for k, v in change.items() if k != "+"}
    own = [c for c in cells if c not in (_TALL_ONLY if wide else ["additional_payer_notes"])]
    return _line([*(cells[c] for c in own), *([change["+"]] if "+" in change else [])])


def _csv_heads() -> dict[int, str]:
    def head(general: dict[str, str] | None = None, columns: list[str] | None = None, wide: bool = False, before: str = "") -> str:
        g = _GENERAL if general is None else general
        own = [_wide(c) for c in [*_TALL_ROW, "additional_payer_notes"] if c not in _TALL_ONLY] if wide else list(_TALL_ROW)
        return before + "\n".join(map(_line, [list(g), list(g.values()), *([own if columns is None else columns] if columns != [] else [])])) + "\n"

    tall = list(_TALL_ROW)
    out = {k: head(_GENERAL | {n: "" if n != _ATTEST else "maybe"} if n != "license_number|OR" else {x: v for x, v in _GENERAL.items() if x != n}) for k, n in enumerate(_GENERALS, 1)}
    out |= {k: head(columns=[c for c in tall if c != n]) for k, n in _COLUMNS}
    whole = [_wide(c) for c in [*_TALL_ROW, "additional_payer_notes"] if c not in _TALL_ONLY]
    out |= {
        30: head(_GENERAL | {"version": "2.0.0"}), 31: head(_GENERAL | {"last_updated_on": "March 2026"}), 32: head({("license_number|[state]" if x == "license_number|OR" else x): v for x, v in _GENERAL.items()}), 33: head(_GENERAL | {_ATTEST: "FALSE"}), 34: head(before="﻿"),
        35: head(_GENERAL | {"last_updated_on": "1/1/2027"}), 36: head(columns=[c for c in tall if not c.endswith("|type")]), 37: head(columns=[]), 38: head(columns=[*tall, *(_wide(c) for c in _PAYER)]), 39: head(columns=[*tall, "code|[i]"]), 40: head(_GENERAL | {"last_updated_on": "8/8/2025"}),
        _LATIN: head(_GENERAL | {"hospital_name": "Clinique du Château"}), 43: head(columns=[*tall, "Modifiers"]), 44: head(columns=[c for c in whole if not c.startswith("count|")]),
    }
    return out | {0: head(wide=True)} | {k: head(wide=True) for k in _WIDES if k not in (0, 44)} | {-1: head()}


def csv_texts(lines: DataFrame) -> DataFrame:
    """The rows of the tables, by supplier."""
    frame, fault = F.col("frame"), F.expr(ITEM_FAULT)
    rows = {wide: {0: _row({}, wide)} | {k: _row({} if wide and k in _ONLY_TALL else change, wide) for k, (change, _) in CSV_ROWS.items()} for wide in (False, True)}
    row = F.when(frame == _PAYERLESS, _row(_NOBODY, False)).when(frame.isin(*_WIDES), _picked(fault, rows[True])).otherwise(_picked(fault, rows[False]))
    return _texts(lines, F.when(~frame.isin(*_ROWLESS), row))


def csv_frames() -> dict[int, sinks.Frame]:
    """What is around the rows of a table, by its fault."""
    heads = _csv_heads()
    tail = lambda k: ("" if k in _ROWLESS else "\n") + ("x" * (CELL_BYTES + 1) + "\n" if k == _CSV_BROKEN else "")
    return {k: (heads.get(k, heads[-1]), tail(k), "latin-1" if k == _LATIN else "utf-8") for k in range(DOCUMENTS)}


def csv_sql() -> str:
    rows = [(k, *f) for k, (_, found) in CSV_ROWS.items() for f in found]
    documents = [(k, *f) for k, found in CSV_DOCUMENTS.items() for f in found]
    several = [(k, "CSV_INTERPRETABILITY_PERCENTAGE_RATES", "interpretability", "INFO") for k in _CSV_PERCENTAGES] + [(k, "CSV_INTERPRETABILITY_ALGORITHM_RATES", "interpretability", "INFO") for k in _CSV_ALGORITHMS]
    without = ", ".join(map(str, (*_ROWLESS, _PAYERLESS)))
    only = " OR ".join(f"(f = {k} AND e IN ({', '.join(map(str, _WIDES))}))" for k in _ONLY_TALL)
    return f"""WITH l AS (SELECT l_suppkey AS supplier, l_suppkey % {DOCUMENTS} AS e, {ITEM_FAULT} AS f FROM {{lineitem}})
    SELECT supplier, code, dimension, severity, count(*) AS occurrences FROM l JOIN (VALUES {_values(rows)}) x(k, code, dimension, severity) ON f = k WHERE e NOT IN ({without}) AND NOT ({only}) GROUP BY ALL
    UNION ALL SELECT DISTINCT supplier, code, dimension, severity, 1 FROM l JOIN (VALUES {_values(several)}) x(k, code, dimension, severity) ON f = k WHERE e NOT IN ({without}) AND e <> {_CSV_BROKEN}
    UNION ALL SELECT DISTINCT supplier, code, dimension, severity, 1 FROM l JOIN (VALUES {_values(documents)}) x(k, code, dimension, severity) ON e = k"""
