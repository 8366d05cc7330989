import io
import json
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratewright.operators import contracts, inspect_json, normalize, rates
from ratewright.sources.charge_json import ChargeJson, scan


def document(**changes):
    """Two items of a made-up clinic: an imaging charge with three kinds of rates, and a vial with a drug's unit."""
    rate = lambda method, **more: {"payer_name": "Harbor Mutual", "plan_name": "Silver", "methodology": method, **more}
    scan_ = {
        "description": "Knee scan", "code_information": [{"code": "73721", "type": "CPT"}, {"code": "K-9", "type": "LOCAL"}],
        "standard_charges": [{"setting": "outpatient", "gross_charge": 640.25, "discounted_cash": 410, "minimum": 215, "maximum": 333.5, "modifier_code": ["TC", " lt ", "Q9"], "payers_information": [
            rate("case rate", standard_charge_dollar=287.4), rate("percent of total billed charges", standard_charge_percentage=41, count="0", additional_payer_notes="no claims yet"), rate("other", standard_charge_algorithm="tiers by volume", count="0", additional_payer_notes="see contract"),
        ]}],
    }
    vial = {"description": "Vial", "drug_information": {"unit": 2, "type": "ML"}, "code_information": [{"code": "0409-1111-01", "type": "NDC"}], "standard_charges": [{"setting": "both", "gross_charge": 12}]}
    of = lambda payer, plan: [{"payer_name": payer, "plan_name": plan, "description": f"for {plan}"}]
    doc = {
        "hospital_name": "Lakeside Clinic", "last_updated_on": "2026-03-15", "version": "3.0.0", "location_name": ["Lakeside", "Quay"], "hospital_address": ["9 Quay Road"], "type_2_npi": ["1770000009"], "license_information": {"state": "OR"}, "attestation": {"attestation": "complete", "confirm_attestation": True, "attester_name": "R. Vale"},
        "standard_charge_information": [scan_, vial],
        "modifier_information": [{"code": "TC", "description": "technical part", "setting": "both", "modifier_payer_information": of("Harbor Mutual", "Silver")}, {"code": "LT", "description": "left side", "modifier_payer_information": of("HARBOR mutual ", " silver")}],
    }
    return doc | changes


def parts(data: bytes, chunk=7):
    return list(scan(io.BytesIO(data), chunk=chunk))


def problem_of(data: bytes):
    return [p[4] for p in parts(data) if p[0] == "stream"]


def test_exact_text_and_places():
    data = b'\xef\xbb\xbf{"a": {"standard_charge_information": [9]}, "standard_charge_information": [ {"x": "}]\\""} , 42, {"d": 1, "d": 2}, {"y": \xff}, {bad}, {"z": 1.50}], "b": [1,\n2] }'
    for chunk in (1, 3, 64, 1 << 20):
        got = parts(data, chunk)
        assert [(p[0], p[2], p[3]) for p in got if p[0] == "standard_charge_information" and not p[4]] == [("standard_charge_information", 0, '{"x": "}]\\""}'), ("standard_charge_information", 5, '{"z": 1.50}')]
        assert [p[2] for p in got if p[4]] == [1, 2, 3, 4] and all(p[5] for p in got)
        assert {p[1]: p[3] for p in got if p[0] == "envelope"} == {"a": '{"standard_charge_information": [9]}', "b": "[1,\n2]"}
        assert [p[2] for p in got if p[0] == "end"] == [6]


@pytest.mark.parametrize("data", [b"", b"[]", b'{"a" 1}', b'{"a": 1,}', b'{"a": 1} x', b'{"a": 1, "a": 2}', b'{"standard_charge_information": [{}', b'{"standard_charge_information": [{},]}', b'{"standard_charge_information": {}}', b'{"standard_charge_information": [{} {}]}', b'{"a": "x'])
def test_broken_documents(data):
    for chunk in (1, 5, 1 << 20):
        assert len(problem_of_chunk(data, chunk)) == 1


def problem_of_chunk(data, chunk):
    return [p[4] for p in parts(data, chunk) if p[0] == "stream"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=5), st.one_of(st.text(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.lists(st.text()))), max_size=6), st.integers(1, 40), st.booleans())
def test_round_trip(items, chunk, ascii_):
    data = json.dumps({"v": 1, "standard_charge_information": items, "w": []}, ensure_ascii=ascii_).encode("utf-8", "surrogatepass")
    got = [p for p in parts(data, chunk) if p[0] == "standard_charge_information"]
    if b"\xed" not in data:
        assert [json.loads(p[3]) for p in got if not p[4]] == items


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    spark.dataSource.register(ChargeJson)

    def load(*docs):
        folder = tmp_path_factory.mktemp("charges")
        for k, d in enumerate(docs):
            (folder / f"f{k}.json").write_bytes(d if isinstance(d, bytes) else json.dumps(d).encode())
        rows = spark.read.format("charge_json").option("chunk", "50").load(str(folder))
        return rows.withColumn("file_id", F.regexp_extract("file", r"(f\d+)\.json", 1)).cache()

    return load


def findings(df, file="f0"):
    return {r.code: r.occurrences for r in df.where(F.col("file_id") == file).collect()}


def test_end_to_end(read):
    rows = read(document())
    t = normalize.normalize(rows)
    assert {k: v.count() for k, v in t.items()} == {"raw_item": 2, "charge_item": 2, "charge_code": 3, "charge_group": 2, "charge_modifier": 3, "payer_rate": 3, "raw_modifier": 2, "modifier": 2, "modifier_payer": 2}
    t["observation"] = rates.observations(t["payer_rate"], t["charge_group"])
    assert sorted((r.rate_kind, r.eligible_for_segmented_comparison) for r in t["observation"].collect()) == [("algorithm", False), ("dollar", True), ("percentage", False)]
    t["file_profile"] = rates.file_profile(t["observation"])
    resolved = rates.resolve_modifiers(t["charge_modifier"], t["charge_group"], t["modifier"])
    assert [r.modifier_resolution_status for r in resolved.orderBy("modifier_ordinal").collect()] == ["exact", "canonical", "unresolved"]
    mapped = rates.map_payers(resolved, t["payer_rate"], t["modifier_payer"])
    context = rates.modifier_context(mapped)
    t["dollar_mart"] = rates.segmented_dollars(t["observation"], t["charge_group"], t["charge_item"], t["charge_code"], context)
    [mart] = t["dollar_mart"].collect()
    assert json.loads(mart.codes_json) == [{"code": "73721", "code_type": "CPT"}, {"code": "K-9", "code_type": "LOCAL"}]
    assert [(c["modifier_setting"], c["payer_mapping_resolution_status"]) for c in json.loads(mart.modifier_context_json)] == [("both", "exact"), (None, "canonical"), (None, "unresolved_modifier")]
    t["file_finding"] = inspect_json.inspect(rows, date(2026, 8, 9))
    assert set(findings(t["file_finding"])) == {"INTERPRETABILITY_PERCENTAGE_RATES", "INTERPRETABILITY_ALGORITHM_RATES"}
    bad = {r.rule: r.violations for r in contracts.evaluate(t).where("violations > 0").collect()}
    assert bad == {} and contracts.enforce(t) is None
    broken = t | {"charge_group": t["charge_group"].withColumn("setting", F.lit("telehealth"))}
    with pytest.raises(contracts.ContractViolation, match="accepted_setting"):
        contracts.enforce(broken)


def test_defects(read):
    group = {"setting": "abroad", "payers_information": [{"payer_name": " ", "plan_name": 5, "methodology": "barter"}, {"payer_name": "p", "plan_name": "q", "methodology": "other", "standard_charge_percentage": 5, "count": "0"}, {"payer_name": "p", "plan_name": "q", "methodology": "per diem", "standard_charge_dollar": 1, "standard_charge_algorithm": "a"}, 7]}
    doc = document(last_updated_on="2026-02-30", version="2.0", type_2_npi=[], attestation={"attestation": "a", "confirm_attestation": False, "attester_name": "x"})
    doc["standard_charge_information"] = [{"description": "\t", "code_information": [{"code": "", "type": 3}, 4], "standard_charges": [group, 5, {"setting": "both", "payers_information": []}, {"setting": "both", "gross_charge": None, "payers_information": None}]}, {"code_information": None}]
    got = findings(inspect_json.inspect(read(doc), date(2026, 8, 9)))
    v = "CMS_V3_"
    assert got == {
        v + "ENVELOPE_TYPE_2_NPI_MISSING": 1, v + "VERSION_UNEXPECTED": 1, v + "LAST_UPDATED_ON_INVALID": 1, v + "ATTESTATION_NOT_CONFIRMED": 1, "FRESHNESS_DATE_NOT_USABLE": 1,
        v + "ITEM_DESCRIPTION_MISSING": 2, v + "ITEM_CODE_INFORMATION_MISSING": 1, v + "ITEM_STANDARD_CHARGES_MISSING": 1, v + "CODE_VALUE_MISSING": 2, v + "CODE_TYPE_MISSING": 2, v + "CHARGE_GROUP_NOT_OBJECT": 1, v + "SETTING_INVALID": 1,
        v + "CHARGE_VALUE_MISSING": 1, v + "PAYERS_INFORMATION_INVALID": 1, v + "DOLLAR_RANGE_MINIMUM_MISSING": 1, v + "DOLLAR_RANGE_MAXIMUM_MISSING": 1, v + "PAYER_RATE_NOT_OBJECT": 1, v + "PAYER_PAYER_NAME_MISSING": 1, v + "PAYER_PLAN_NAME_MISSING": 1,
        v + "METHODOLOGY_INVALID": 1, v + "OTHER_METHODOLOGY_NOTES_MISSING": 1, v + "PAYER_CHARGE_MISSING": 1, v + "DERIVED_RATE_COUNT_MISSING": 1, v + "ZERO_COUNT_NOTES_MISSING": 1,
        v + "DERIVED_RATE_10TH_PERCENTILE_MISSING": 1, v + "DERIVED_RATE_MEDIAN_AMOUNT_MISSING": 1, v + "DERIVED_RATE_90TH_PERCENTILE_MISSING": 1, "INTERPRETABILITY_PERCENTAGE_RATES": 1, "INTERPRETABILITY_ALGORITHM_RATES": 1,
    }


def test_messages_show_the_first_value(read):
    doc = document(version="2.0", last_updated_on=["https://user:pw@a.org/x?key=1", "/home/me/f"])
    group = doc["standard_charge_information"][1]["standard_charges"][0]
    doc["standard_charge_information"] = [{"description": "a", "code_information": [{"code": "1", "type": "CPT"}], "standard_charges": [group | {"setting": x}]} for x in ("abroad\n again", None, "x" * 500)] + [{"description": "b", "code_information": [{"code": "1", "type": "CPT"}], "standard_charges": [[1, {"a": 2}], "later"]}]
    got = {r.code: r.message for r in inspect_json.inspect(read(doc), date(2026, 8, 9)).collect()}
    assert got["CMS_V3_SETTING_INVALID"].endswith(': "abroad\\n again"') and got["CMS_V3_CHARGE_GROUP_NOT_OBJECT"].endswith(': [1,{"a":2}]') and got["CMS_V3_VERSION_UNEXPECTED"].endswith(': "2.0"')
    assert "pw" not in got["CMS_V3_LAST_UPDATED_ON_INVALID"] and "key" not in got["CMS_V3_LAST_UPDATED_ON_INVALID"] and "/home" not in got["CMS_V3_LAST_UPDATED_ON_INVALID"]
    long = document()
    long["standard_charge_information"][0]["standard_charges"][0]["setting"] = "y" * 500
    [message] = [r.message for r in inspect_json.inspect(read(long), date(2026, 8, 9)).collect() if r.code == "CMS_V3_SETTING_INVALID"]
    assert len(message) < 150


def test_files_are_told_apart(read):
    old, future, none = document(last_updated_on="2025-08-08"), document(last_updated_on="2026-08-10"), document(standard_charge_information=[])
    rows = read(old, future, none, b'\xef\xbb\xbf{"standard_charge_information": [42', json.dumps({"x": 1}).encode())
    got = inspect_json.inspect(rows, date(2026, 8, 9))
    assert "FRESHNESS_ANNUAL_UPDATE_OVERDUE" in findings(got) and "FRESHNESS_DATE_IN_FUTURE" in findings(got, "f1")
    assert "CMS_V3_STANDARD_CHARGE_INFORMATION_EMPTY" in findings(got, "f2")
    assert {"JSON_STREAM_INCOMPLETE", "JSON_UTF8_BOM_PRESENT", "FRESHNESS_DATE_NOT_USABLE"} <= set(findings(got, "f3"))
    assert "CMS_V3_ENVELOPE_STANDARD_CHARGE_INFORMATION_MISSING" in findings(got, "f4")


def test_content_and_peek(spark, read, tmp_path):
    import hashlib

    data = json.dumps(document()).encode()
    rows = normalize.by_content(read(data, data, json.dumps({"x": 1}).encode()).drop("file_id"))
    assert {r.file_id for r in rows.select("file_id").distinct().collect()} == {hashlib.sha256(x).hexdigest() for x in (data, b'{"x": 1}')}
    [r] = normalize.envelope(read(data)).select("source_sha256", "source_size").collect()
    assert tuple(r) == (hashlib.sha256(data).hexdigest(), len(data))
    (tmp_path / "f.json").write_bytes(data)
    load = lambda **how: spark.read.format("charge_json").options(mode="envelope", **how).load(str(tmp_path)).collect()
    assert [r.name for r in load()] == list(document())[:8] and all(r.part == "envelope" for r in load())
    assert [r.name for r in load(max_bytes="60")] == ["hospital_name"]


def test_problems_types_and_refusals(read):
    doc = document()
    doc["standard_charge_information"] += [5, [1], "x"]
    doc["standard_charge_information"][0]["standard_charges"][0]["gross_charge"] = "640"
    rows = read(doc, document(version="2.0.0"), {k: v for k, v in document().items() if k != "attestation"}, document(last_updated_on="15 March"), document(version=3))
    [p] = normalize.problems(rows, 2).collect()
    assert p.file_id == "f0" and p.problem_count == 3 and [x.ordinal for x in p.problem_samples] == [2, 3]
    assert [tuple(r) for r in normalize.type_errors(rows).collect()] == [("f0", "charge.gross_charge", "number", "STRING", 1)]
    with pytest.raises(normalize.WrongType, match="gross_charge is STRING, not number: 1"):
        normalize.require_types(rows)
    fields = tuple(list(document())[:8])
    got = {r.file_id: r.reason for r in normalize.load_refusals(normalize.envelope(rows), "3.0.0", fields).collect()}
    assert got == {"f1": "another template version: 2.0.0", "f2": "missing fields: attestation", "f3": "not an ISO date: 15 March", "f4": "name, date or version isn't text"}
    with pytest.raises(normalize.LoadRefused, match="another template version"):
        normalize.require_loadable(normalize.envelope(rows), "3.0.0", fields)


def test_counters(read):
    [r] = inspect_json.counters(read(document())).collect()
    assert (r.item_count, r.code_count, r.charge_group_count, r.payer_rate_count, r.dollar_rate_count, r.percentage_rate_count, r.algorithm_rate_count, r.payer_plan_combination_count) == (2, 3, 2, 3, 1, 1, 1, 1)
    assert r.settings == ["both", "outpatient"] and r.methodologies == ["case rate", "other", "percent of total billed charges"]
