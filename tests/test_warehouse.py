import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from ratewright.operators import compare, contracts, document
from ratewright.plans import warehouse as W
from ratewright.sources import hpt, snapshots

SOURCE = "0" * 64


def tables(spark):
    item = spark.createDataFrame([("i", "Visit", None, None)], "item_id string, description string, drug_unit decimal(38,10), drug_type string")
    code = spark.createDataFrame([("i", 0, "99213", "CPT")], "item_id string, code_ordinal long, code string, code_type string")
    group = spark.createDataFrame([("g", "i", "both")], "charge_group_id string, item_id string, setting string").withColumns({c: F.lit(5).cast("decimal(38,10)") for c in ("minimum_amount", "maximum_amount", "gross_charge", "discounted_cash")})
    return {"charge_item": item, "charge_code": code, "charge_group": group}


RULES = [r for r in contracts.RULES if r.model in ("charge_item", "charge_code", "charge_group") and r.name not in ("has_charge_value", "dollar_rates_require_range")]


def test_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(contracts, "RULES", RULES)
    root = f"file://{tmp_path}/w"
    args = (root, "a b/c", date(2026, 5, 1), "3.0.0", SOURCE, date(2026, 8, 9))
    first = W.write(spark, tables(spark), *args)
    again = W.write(spark, tables(spark), *args)
    assert not first["reused"] and again["reused"] and first["counts"] == {"charge_item": 1, "charge_code": 1, "charge_group": 1}
    other = W.write(spark, tables(spark), *args[:-1], date(2026, 8, 10))
    assert other["run_id"] != first["run_id"]
    assert W.read(spark, root, "charge_item", first["run_id"]).count() == 1
    bad = tables(spark) | {"charge_group": tables(spark)["charge_group"].withColumn("setting", F.lit("telehealth"))}
    with pytest.raises(contracts.ContractViolation, match="accepted_setting: 1"):
        W.write(spark, bad, root, "p", date(2026, 5, 1), "3.0.0", SOURCE, date(2026, 8, 9))
    assert W.existing(spark, root, W.run_id("p", SOURCE, date(2026, 8, 9))) is None
    assert not list((tmp_path / "w/_staging").glob("*"))
    wrong = tables(spark) | {"charge_code": tables(spark)["charge_code"].withColumn("code_ordinal", F.col("code_ordinal").cast("string"))}
    with pytest.raises(contracts.ContractViolation, match="charge_code.code_ordinal: string, not bigint"):
        W.write(spark, wrong, *args[:1], "q", *args[2:])
    rows = W.read(spark, root, "charge_code", other["run_id"])
    where = tmp_path / "w/staging/charge_code/publisher_id=a b%2Fc/period=2026-05-01/file_version=3.0.0" / f"run_id={other['run_id']}"
    assert rows.count() == 1 and where.is_dir()
    rows.drop(*W.PARTITIONS).withColumn("code", F.lit("99999")).write.mode("overwrite").parquet(f"file://{tmp_path}/other")
    for old in where.glob("*"):
        old.unlink()
    for new in (tmp_path / "other").glob("part-*"):
        new.rename(where / new.name)
    with pytest.raises(ValueError, match="charge_code"):
        W.existing(spark, root, other["run_id"])
    [part] = (tmp_path / "w/manifests" / first["run_id"]).glob("part-*")
    part.write_text(part.read_text().replace('"charge_code":1', '"charge_code":2'))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="was changed"):
        W.existing(spark, root, first["run_id"])
    measured = {r.model: r for r in snapshots.metrics(spark, root).where(F.col("run_id") == other["run_id"]).collect()}
    sizes = {m: sum(a["bytes"] for a in other["artifacts"] if f"/{m}/" in a["path"]) for m in measured}
    assert {m: (r.rows_produced, r.bytes_written, r.layer) for m, r in measured.items()} == {m: (1, sizes[m], W.LAYERS[m]) for m in other["counts"]} and all(r.wall_ms > 0 for r in measured.values())


def test_runs_are_whole_or_invisible(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(contracts, "RULES", RULES)
    root, run = f"file://{tmp_path}/w", W.run_id("p", SOURCE, date(2026, 8, 9))
    args = (root, "p", date(2026, 5, 1), "3.0.0", SOURCE, date(2026, 8, 9))
    rename, moves = W._rename, []

    def stopped(spark, source, target):
        if "/charge_code/" in target and "_staging" not in target:
            raise KeyboardInterrupt
        moves.append(target)
        rename(spark, source, target)

    # a promotion that fails puts back what it had moved
    monkeypatch.setattr(W, "_rename", stopped)
    with pytest.raises(KeyboardInterrupt):
        W.write(spark, tables(spark), *args)
    assert len(moves) == 2 and not list((tmp_path / "w").glob("staging/*/*/*/*/*")) and not list((tmp_path / "w/_staging").glob("*"))
    # a run that was killed between two models can't be read, and the next one clears it away
    monkeypatch.setattr(W, "_rename", rename)
    left = tmp_path / "w/staging/charge_item/publisher_id=p/period=2026-05-01/file_version=3.0.0" / f"run_id={run}"
    tables(spark)["charge_item"].union(tables(spark)["charge_item"]).write.parquet(f"file://{left}")
    with pytest.raises(W.NotVisible):
        W.read(spark, root, "charge_item", run)
    done = W.write(spark, tables(spark), *args)
    assert not done["reused"] and W.read(spark, root, "charge_item", run).count() == 1
    with pytest.raises(FileExistsError):
        W._rename(spark, f"{root}/manifests", f"file://{left}")
    # reuse reads no row, and finds a file that is missing or more
    assert W.write(spark, {m: df.where(F.raise_error(F.lit("read")) == "x") for m, df in tables(spark).items()}, *args)["reused"]
    tables(spark)["charge_item"].write.mode("append").parquet(f"file://{left}")
    with pytest.raises(ValueError, match="charge_item"):
        W.existing(spark, root, run)


def test_types(spark):
    assert contracts.type_differences(tables(spark)["charge_item"], {"item_id": "string", "drug_unit": "decimal(38,10)"}) == []
    assert contracts.type_differences(tables(spark)["charge_item"], {"item_id": "bigint", "x": "string"}) == ["item_id: string, not bigint", "x: missing, not string"]


def test_seals():
    record = W.seal({"b": 1, "a": ["é"]})
    assert W.sealed(record) and W.sealed(json.loads(json.dumps(record))) and not W.sealed(record | {"b": 2})


def test_comparison(spark):
    files = spark.createDataFrame([("b", "p1", "s", "A", True, True, True, "x"), ("a", "p2", "s", "NOT_GRADED", True, False, False, None)], "slug string, publisher string, scope string, grade string, network_attempted boolean, verified_body_available boolean, inspection_scan_completed boolean, content_sha256 string")
    found = spark.createDataFrame([("a", "C1", 2), ("b", "C1", 3), ("b", "C0", 1)], "slug string, code string, occurrences long")
    found = found.withColumns({"dimension": F.lit("conformance"), "severity": F.lit("ERROR")})
    dated = files.withColumn("as_of", F.lit("2026-08-09"))
    manifest = {"cohort_id": "c", "collection": {"operator_controlled_single_run": True, "utc_date": "2026-08-09"}}
    out = compare.build(dated, found, ["scope"], ["publisher"], manifest)
    assert out["header"]["comparison_scope"] == {"scope": "s"} and out["header"]["cohort_id"] == "c" and len(out["header"]["grade_policy"]["fingerprint"]) == 64
    for wrong, match in (({}, "attest"), ({"collection": {"operator_controlled_single_run": True}}, "lacks"), (manifest | {"collection": manifest["collection"] | {"utc_date": "2026-08-10"}}, "2 assessments are of another day")):
        with pytest.raises(compare.NotComparable, match=match):
            compare.build(dated, found, ["scope"], ["publisher"], wrong)
    assert [r.slug for r in out["files"].collect()] == ["a", "b"]
    with pytest.raises(compare.NotComparable, match="2 files have the slug a"):
        compare.build(dated.withColumn("slug", F.lit("a")), found, ["scope"], ["publisher"], manifest)
    assert [tuple(r) for r in out["finding_matrix"].collect()] == [("C0", "conformance", "ERROR", 1, 1), ("C1", "conformance", "ERROR", 5, 2)]
    assert [tuple(r) for r in out["finding_files"].collect()] == [("C0", "b", 1), ("C1", "a", 2), ("C1", "b", 3)]
    assert out["summary"].first().asDict() == {"targeted": 2, "network_attempted": 2, "verified_body_available": 1, "inspection_scan_completed": 1, "graded": 1, "not_graded": 1, "A": 1, "B": 0, "C": 0, "D": 0, "F": 0}
    for bad, match in ((files.limit(1), "at least 2"), (files.withColumn("scope", F.col("slug")), "2 scopes"), (files.withColumn("publisher", F.lit("p")), "repeat a subject")):
        with pytest.raises(compare.NotComparable, match=match):
            compare.require_comparable(bad, ["scope"], ["publisher"])
    evidence = spark.createDataFrame([("x", "success")], "content_sha256 string, ingest string")
    assert {r.slug: r.ingest for r in compare.attach_evidence(files, evidence).collect()} == {"a": None, "b": "success"}
    with pytest.raises(compare.NotComparable, match="1 pieces"):
        compare.attach_evidence(files, evidence.withColumn("content_sha256", F.lit("other")))


def test_discovery_documents(spark):
    block = "location-name: A\nsource-page-url: https://a.org/p\nmrf_url: https://a.org/f.json\ncontact-name: N\ncontact-email: n@a.org\n"
    rows = [("one", "\ufeff# note\r\n" + block), ("two", block + block.replace("A\n", "B\n") + "\nextra: x\nnonsense\nmrf-url:\nmrf-url: ftp://x"), ("html", "<html>"), ("none", " ")]
    spark.createDataFrame(rows, "domain string, text string").createOrReplaceTempView("hpt_documents")
    hpt.register(spark)
    got = {}
    for r in spark.sql("SELECT d.domain, h.* FROM hpt_documents d, LATERAL parse_hpt(d.text) h ORDER BY domain, entry").collect():
        got.setdefault(r.domain, []).append(r)
    assert [(r.location_name, r.mrf_url, r.problems) for r in got["one"]] == [("A", "https://a.org/f.json", [])]
    assert [r.location_name for r in got["two"]] == ["A", "B", None] and got["two"][2].extra == {"extra": "x"} and got["two"][2].mrf_url is None
    assert set(got["two"][2].problems) >= {"not a field: nonsense", "mrf-url is empty", "mrf-url isn't an https address", "no location-name"}
    assert got["html"][0].problems == ["HTML instead of a discovery document"] and got["none"][0].problems == ["the document is empty"]


def test_documents_are_the_same_bytes(spark, tmp_path):
    rows = [(f"s{k:03d}", k, None if k % 3 else 1.5, f'quote " \u00e9 {k}') for k in range(200)]
    df = spark.createDataFrame(rows, "slug string, n long, x double, note string")
    small = {"b": {"z": 1, "a": [None, True]}, "zz": "end", "A": 0.1}
    want = {**small, "files": [dict(zip(("slug", "n", "x", "note"), r)) for r in rows], "none": []}
    text = json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    for parts in (1, 7, 40):
        path = tmp_path / f"d{parts}" / "document.json"
        dealt = df.repartition(parts)
        done = document.write(spark, small, {"files": document.rows_of(dealt, "slug"), "none": document.rows_of(df.limit(0), "slug")}, f"file://{path}")
        assert path.read_bytes() == text and done == (len(text), hashlib.sha256(text).hexdigest())
    document.write(spark, {}, {"last": document.rows_of(df.limit(1), "slug")}, f"file://{tmp_path}/one")
    assert json.loads((tmp_path / "one").read_text()) == {"last": [want["files"][0]]} or len(json.loads((tmp_path / "one").read_text())["last"]) == 1
    with pytest.raises(document.NoOrder, match="several rows of 's001'"):
        document.write(spark, {}, {"x": document.rows_of(df.union(df.where("slug = 's001'")), "slug")}, f"file://{tmp_path}/two")


def test_a_comparison_is_published(spark, tmp_path):
    files = spark.createDataFrame([(s, p, "s", "A", True, True, True, "x") for s, p in (("b", "p1"), ("a", "p2"))], "slug string, publisher string, scope string, grade string, network_attempted boolean, verified_body_available boolean, inspection_scan_completed boolean, content_sha256 string")
    found = spark.createDataFrame([("a", "C1", 2, "conformance", "ERROR"), ("b", "C1", 3, "conformance", "ERROR")], "slug string, code string, occurrences long, dimension string, severity string")
    compare.publish(compare.build(files, found, ["scope"], ["publisher"]), f"file://{tmp_path}/c.json", "2026-08-09T00:00:00Z")
    got = json.loads((tmp_path / "c.json").read_text())
    assert list(got) == ["comparison_version", "files", "finding_matrix", "generated_at", "summary"] and [f["slug"] for f in got["files"]] == ["a", "b"]
    assert [(m["code"], m["slugs"]) for m in got["finding_matrix"]] == [("C1", ["a", "b"])] and got["summary"]["A"] == 2
