import csv
import io
from datetime import date

import pytest
from pyspark.sql import functions as F

from ratewright.operators import inspect_csv as I
from ratewright.sources.charge_csv import ChargeCsv

ATTEST = "To the best of its  knowledge and belief, this hospital has included all applicable standard charge information, and so on."
#: General elements and the columns of a Tall table, with the values of a made-up clinic and one of its charges.
CLINIC = {"hospital_name": "Lakeside Clinic", "location_name": "Lakeside|Quay", "hospital_address": "9 Quay Road", "last_updated_on": "3/15/2026", "version": "3.0.0", "type_2_npi": "1770000009", "license_number|OR": "77", "attester_name": "R. Vale", ATTEST: "TRUE"}
CHARGE = {
    "standard_charge|gross": "640.25", "standard_charge|discounted_cash": "410", "standard_charge|min": "215", "standard_charge|max": "333.5", "setting": "Outpatient", "description": "Knee scan", "code|1": "73721", "code|1|type": "CPT", "modifiers": "", "drug_unit_of_measurement": "", "drug_type_of_measurement": "",
    "payer_name": "Harbor Mutual", "plan_name": "Silver", "standard_charge|methodology": "case rate", "standard_charge|negotiated_dollar": "287.4", "standard_charge|negotiated_percentage": "", "standard_charge|negotiated_algorithm": "", "count": "", "10th_percentile": "", "median_amount": "", "90th_percentile": "", "additional_generic_notes": "",
}
GENERAL, VALUES, TALL, CLEAN = list(CLINIC), list(CLINIC.values()), list(CHARGE), list(CHARGE.values())
_OF_PAYER = {n: f"{n.replace('standard_charge|', 'standard_charge|Harbor Mutual|Silver|')}" if n.startswith("standard_charge|") else f"{n}|Harbor Mutual|Silver" for n in TALL[13:21]}
_WIDE = {_OF_PAYER.get(n, n): v for n, v in CHARGE.items() if n not in ("payer_name", "plan_name")} | {"additional_payer_notes|Harbor Mutual|Silver": ""}
WIDE, WIDE_CLEAN = list(_WIDE), list(_WIDE.values())


def table(*rows, general=GENERAL, values=VALUES, header=TALL):
    out = io.StringIO()
    csv.writer(out).writerows([general, values, header, *rows])
    return out.getvalue().encode()


def row(**cells):
    return [cells.get(n.replace("|", "_"), v) for n, v in zip(TALL, CLEAN, strict=True)]


@pytest.fixture(scope="module")
def inspect(spark, tmp_path_factory):
    spark.dataSource.register(ChargeCsv)

    def run(*files):
        folder = tmp_path_factory.mktemp("tables")
        for k, data in enumerate(files):
            (folder / f"f{k:02d}.csv").write_bytes(data)
        rows = spark.read.format("charge_csv").load(str(folder)).withColumn("file_id", F.regexp_extract("file", r"(f\d+)\.csv", 1)).cache()
        out = {f"f{k:02d}": {} for k in range(len(files))}
        for r in I.inspect(rows, date(2026, 8, 9)).collect():
            out[r.file_id][r.code.removeprefix("CMS_CSV_")] = r.occurrences
        return [out[k] for k in sorted(out)]

    return run


def test_clean_and_layouts(inspect):
    spaced = [" " + h.upper().replace("|", " | ") for h in TALL]
    tall, wide, upper, bom, latin, empty, short, nothing, mixed, partial = inspect(
        table(CLEAN), table(WIDE_CLEAN, header=WIDE), table(CLEAN, header=spaced), b"\xef\xbb\xbf" + table(CLEAN), table(row(description="Genü")).decode().encode("latin-1"),
        table(), table(CLEAN).split(b"\r\n")[0] + b"\r\n", b"", table([*CLEAN, "1"], header=[*TALL, "standard_charge|Another|Gold|negotiated_dollar"]), table(WIDE_CLEAN[:-1], header=WIDE[:-1]),
    )
    assert tall == wide == upper == {}
    assert bom == {"UTF8_BOM_PRESENT": 1} and latin == {"ENCODING_NOT_UTF8": 1}
    assert empty == {"TABLE_EMPTY": 1}
    assert "CHARGE_HEADER_ROW_MISSING" in short and "GENERAL_HOSPITAL_NAME_MISSING" in short
    assert "CHARGE_HEADER_ROW_MISSING" in nothing and "GENERAL_VERSION_MISSING" in nothing
    assert "LAYOUT_AMBIGUOUS" in mixed and mixed["WIDE_PAYER_HEADER_SET_INCOMPLETE"] == 1
    assert partial == {"WIDE_PAYER_HEADER_SET_INCOMPLETE": 1}


def test_general_and_headers(inspect):
    bad = VALUES.copy()
    bad[3], bad[4], bad[8] = "02/30/2026", "2.2", "False"
    holder = ["license_number|[state]" if g == "license_number|OR" else g for g in GENERAL]
    general, placeholders, header = inspect(table(CLEAN, values=bad), table(CLEAN, general=holder), table([*CLEAN, "", ""], header=[*[h for h in TALL if h != "setting"], "description", "code|[i]", "extra"]))
    assert general == {"LAST_UPDATED_ON_INVALID": 1, "VERSION_UNEXPECTED": 1, "ATTESTATION_NOT_CONFIRMED": 1, "CSV_FRESHNESS_DATE_NOT_USABLE": 1}
    assert placeholders == {"PLACEHOLDER_NOT_REPLACED": 1, "GENERAL_LICENSE_NUMBER_MISSING": 1}
    assert header["HEADER_NOT_UNIQUE"] == 1 and header["PLACEHOLDER_NOT_REPLACED"] == 1 and header["COLUMN_SETTING_MISSING"] == 1


def test_rows(inspect):
    cases = {
        "ROW_WIDTH_MISMATCH": [*CLEAN, "", "x"], "NUMERIC_VALUE_INVALID": row(standard_charge_gross="640 USD"), "SETTING_INVALID": row(setting=""), "DRUG_FIELDS_UNPAIRED": row(drug_unit_of_measurement="3"),
        "COUNT_VALUE_INVALID": row(count="7"), "METHODOLOGY_INVALID": row(standard_charge_methodology="barter"), "PAYER_CONTEXT_MISSING": row(plan_name=" "), "DESCRIPTION_MISSING": row(description=""),
        "OTHER_METHODOLOGY_NOTES_MISSING": row(standard_charge_methodology="Other"), "DOLLAR_RANGE_MISSING": row(standard_charge_min=""), "CODE_TYPE_INVALID": row(code_1_type="XYZ"),
    }
    got = inspect(*[table(c) for c in cases.values()])
    assert got == [{k: 1} for k in cases]
    derived = row(standard_charge_negotiated_dollar="", standard_charge_negotiated_percentage="41")
    at = TALL.index("count")
    with_count = lambda v: [v if k == at else c for k, c in enumerate(derived)]
    none, zero, some, ndc, modifier, bare, unpaired, named = inspect(
        table(derived), table(with_count("0")), table(with_count("18")), table(row(code_1_type="NDC")), table(row(code_1="", code_1_type="", modifiers="LT", description="")),
        table(row(code_1="", code_1_type="")), table(row(code_1_type="")), table(row(standard_charge_negotiated_dollar="", standard_charge_methodology="")),
    )
    p = {"CSV_INTERPRETABILITY_PERCENTAGE_RATES": 1}
    assert none == {"DERIVED_RATE_COUNT_MISSING": 1} | p and zero == {"ZERO_COUNT_NOTES_MISSING": 1} | p and some == {"DERIVED_RATE_PERCENTILES_MISSING": 1} | p
    assert ndc == {"NDC_DRUG_FIELDS_MISSING": 1} and modifier == {"MODIFIER_ROW_CONTEXT_MISSING": 1} and bare == {"CODE_PAIRING_MISSING": 1}
    assert unpaired == {"CODE_TYPE_UNPAIRED": 1, "CODE_PAIRING_MISSING": 1} and named == {"PAYER_WITHOUT_CHARGE": 1}


def test_header_resolution():
    h = I.resolve(["Code | 2 | type", "code|1", " Description", "description", "count|A|B", "standard_charge|A|B|methodology", "x|A|B"])
    assert h["names"] == [None, None, "description", None, None, None, "x|a|b"] and h["repeated"] == 1
    assert h["codes"] == [{"code": 1, "type": None}, {"code": None, "type": 0}]
    assert h["combos"] == [{"combo": "a|b", "at": {"count": 4, "standard_charge|methodology": 5}}]
