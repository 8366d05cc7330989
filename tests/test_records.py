import copy
import hashlib
import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratewright.functions import canonical as C
from ratewright.operators import records as R
from ratewright.sources import registries
from ratewright.sources import registry_files as W

dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
sha = lambda x: hashlib.sha256(dump(x).encode()).hexdigest()
LOCAL = ("conformance", "completeness", "interpretability", "freshness")


def card(status, errors=0, warnings=0, infos=0):
    return {"status": status, "errors": errors, "warnings": warnings, "infos": infos}


def seal(body):
    """The record's seals and identity, worked out by hand."""
    body = {k: v for k, v in copy.deepcopy(body).items() if k not in ("assessment_id", "assessment_body_sha256")}
    s, i = body["subject"], body["inspection"]
    own = {"as_of": body["as_of"], "observed_at": body["observed_at"], "version": body["version"], "assessment_policy_fingerprint": body["assessment_policy_fingerprint"], "retrieval_policy_fingerprint": body["retrieval_policy"]["fingerprint"], "retrieval_evidence_sha256": body["retrieval_evidence_sha256"], "inspection_source_sha256": i["source_sha256"] if i else None, "subject": {"publisher_identifier": s["publisher"]["identifier"]} | {k: s[k] for k in ("location_id", "publisher_type", "requested_url", "requested_url_sha256", "url_provenance")}}
    return body | {"assessment_id": sha(own), "assessment_body_sha256": sha(body)}


def record(url="https://a.org/x", inspected=True):
    policy = {"max_bytes": 5000, "user_agent": "\u00fcn\u00ef \U0001f600", "waits": [1, 2.5, 1e22], "execution_strategy": "default"}
    policy["fingerprint"] = sha(policy)
    retrieval = {"url": url, "attempted_at": "2026-08-01T23:30:00-02:00", "status": "fetched" if inspected else "http_error", "http_status": 200 if inspected else 403, "attempts": 1, "error": None, "content_sha256": "c" if inspected else None, "size_bytes": 7 if inspected else None}
    found = [{"code": "A", "dimension": "conformance", "severity": "ERROR", "occurrences": 3}, {"code": "B", "dimension": "freshness", "severity": "INFO", "occurrences": 1}]
    local = {"conformance": card("FINDINGS", 1), "completeness": card("OBSERVED"), "interpretability": card("NOT_ASSESSED"), "freshness": card("FINDINGS", infos=1)}
    return seal({
        "version": 1, "as_of": "2026-08-02", "observed_at": retrieval["attempted_at"], "assessment_policy_fingerprint": "f", "profile": "json", "retrieval": retrieval, "retrieval_policy": policy, "retrieval_evidence_sha256": sha(retrieval),
        "subject": {"requested_url": url, "requested_url_sha256": hashlib.sha256(url.encode()).hexdigest(), "location_id": "l", "publisher_type": "hospital", "url_provenance": "operator", "publisher": {"identifier": "p", "name": 'quote " and \\ \u00e9'}},
        "inspection": {"source_sha256": "c", "source_size": 7, "as_of": "2026-08-02", "publisher": "p", "scan_completed": True, "items": 0, "findings": found, "local_dimensions": local} if inspected else None,
        "scorecard": (local if inspected else {d: card("NOT_ASSESSED") for d in LOCAL}) | {"retrievability": card("OBSERVED") if inspected else card("FINDINGS", 1)},
        "coverage": {"inspection_performed": inspected, "inspection_scan_completed": inspected, "network_attempted": True, "targeted": True, "verified_body_available": inspected}, "operational_problems": [],
        "comparison_scope": {"as_of": "2026-08-02", "assessment_policy_fingerprint": "f", "profile": "json", "publisher_type": "hospital", "retrieval_policy_fingerprint": policy["fingerprint"], "url_provenance": "operator"},
    })


def changed(path, value, base=None, reseal=True, evidence=False):
    r = copy.deepcopy(base or record())
    at = r
    *parts, last = path.split(".")
    for p in parts:
        at = at[p]
    at[last] = value
    if evidence:
        r["retrieval_evidence_sha256"] = sha(r["retrieval"])
    return seal(r) if reseal else r


def cases():
    good = record()
    return [
        (None, good), (None, record(inspected=False)), ("not a record", "{oops"), ("not a record", dump(good)[:-1] + ',"version":1}'), ("not a record", "[1]"), ("another version", changed("version", 2)), ("the body isn't what was sealed", changed("subject.publisher.name", "x", reseal=False)),
        ("the retrieval isn't what was sealed", changed("retrieval.attempts", 9)), ("the policy isn't what was sealed", changed("retrieval_policy.max_bytes", 1)), ("another address was retrieved", changed("retrieval.url", "https://b.org", evidence=True)), ("the address isn't that of its digest", changed("subject.requested_url_sha256", "0")),
        ("the times of observation differ", changed("observed_at", "2026-08-01T00:00:00Z")), ("the day isn't that of the retrieval", changed("as_of", "2026-08-01")), ("the scope is of another day", changed("comparison_scope.as_of", "2026-08-01")), ("the scope isn't that of its parts", changed("comparison_scope.profile", "csv")),
        ("the scope isn't that of its parts", changed("comparison_scope.more", "x")), ("the identity isn't that of its parts", changed("assessment_id", "x", reseal=False)), ("only a successful retrieval can have an inspection", changed("retrieval.status", "too_large", evidence=True)),
        ("the days of inspection and retrieval differ", changed("inspection.as_of", "2026-08-03")), ("the inspection is of another publisher", changed("inspection.publisher", "q")), ("other bytes were inspected", changed("inspection.source_sha256", "d")), ("another number of bytes was inspected", changed("inspection.source_size", 8)),
        ("a problem isn't fit for publication", changed("operational_problems", ["see /home/me/secret.json"])), ("a problem isn't fit for publication", changed("operational_problems", "x")), ("the retrievability isn't what the retrieval says", changed("operational_problems", ["could not read it again"])),
        ("the retrievability isn't what the retrieval says", changed("scorecard.retrievability.errors", 1)), ("the retrievability isn't what the retrieval says", changed("scorecard.retrievability.status", "OBSERVED", record(inspected=False))), ("the local dimensions aren't what the findings say", changed("scorecard.freshness.infos", 0)),
        ("the local dimensions aren't what the findings say", changed("inspection.local_dimensions.conformance", card("OBSERVED"))), ("the local dimensions aren't what the findings say", changed("inspection.findings", [])), ("the local dimensions aren't what the findings say", changed("inspection.items", 4)),
        ("the local dimensions aren't what the findings say", changed("scorecard.conformance", card("OBSERVED"), record(inspected=False))), ("the coverage isn't what was done", changed("coverage.targeted", False)), ("the coverage isn't what was done", changed("coverage.inspection_performed", True, record(inspected=False))),
    ]


def table(spark, rows):
    return spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in rows], "value string")


def test_each_part_has_its_reason(spark):
    want = cases()
    got = R.verify(table(spark, [x for _, x in want])).collect()
    assert [r.problem for r in got] == [w for w, _ in want]
    assert (got[0].assessment_id, got[0].as_of, got[0].publisher_id, got[0].status, got[0].strategy) == (record()["assessment_id"], "2026-08-02", "p", "fetched", "default")
    with pytest.raises(registries.BadRecords, match="not a record: 3"):
        registries.require_good(R.verify(table(spark, [x for _, x in want])))
    assert R.verify(table(spark, [])).count() == 0


def test_sealing_is_the_same_by_hand(spark):
    raw = [{k: v for k, v in r.items() if k not in ("assessment_id", "assessment_body_sha256", "retrieval_evidence_sha256")} for r in (record(), record(inspected=False))]
    for r in raw:
        r["comparison_scope"]["retrieval_policy_fingerprint"] = None
    got = table(spark, raw).select(R.sealed_record("value").alias("value"))
    assert [r.value for r in got.collect()] == [dump(record()), dump(record(inspected=False))]


def test_comparisons(spark):
    two = [record(), record("https://b.org/y")]
    assert R.require_comparable(R.verify(table(spark, two))).count() == 2
    custom = record("https://c.org")
    custom["retrieval_policy"]["execution_strategy"] = "custom"
    custom["retrieval_policy"]["fingerprint"] = sha({k: v for k, v in custom["retrieval_policy"].items() if k != "fingerprint"})
    custom["comparison_scope"]["retrieval_policy_fingerprint"] = custom["retrieval_policy"]["fingerprint"]
    other = record("https://d.org")
    other["profile"] = other["comparison_scope"]["profile"] = "csv"
    for rows, why in (([*two, seal(custom)], "custom way"), ([*two, seal(other)], "scopes differ"), ([*two, changed("version", 2)], "1 of 3 records")):
        with pytest.raises(R.NotComparable, match=why):
            R.require_comparable(R.verify(table(spark, rows)))


VALUE = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(st.characters(codec="utf-8"))), lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.text(st.characters(codec="utf-8"), max_size=4), x, max_size=4)), max_leaves=12)


def test_canonical_text_is_the_drivers(spark):
    found = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(VALUE)
    def gather(x):
        found.append(x)

    gather()
    found += [{"\U0001f600": 1, "\uffee": 2, "b": 3, "a": 4}, {"x": [1e16, 1e-7, 0.1, -0.0, 12345678901234567890, 1.0]}]
    values = [json.dumps(x, ensure_ascii=bool(k % 2), indent=k % 3) for k, x in enumerate(found)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x string").repartition(4)
    got = {r.k: (r.c, r.d) for r in df.select("k", C.canonical_json("x").alias("c"), C.json_digest("x").alias("d")).collect()}
    assert got == {k: (dump(x), sha(x)) for k, x in enumerate(found)}
    assert C.sealed(C.seal({"a": 1})) and not C.sealed(C.seal({"a": 1}) | {"a": 2})


def test_strict_json(spark):
    good = ['{"a": [1, 2.5e3, "x\\u00e9"]}', "null", "[]", ' {"b": {}} ']
    bad = ['{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 1}}', "NaN", '{"a": Infinity}', "{} x", "{}{}", "{'a': 1}", "", "{", '{"a": 01}', '"\\ud800"', None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(good + bad)], "k int, x string")
    assert [r.ok for r in rows.select("k", C.strict_json(F.col("x")).alias("ok")).orderBy("k").collect()] == [True] * len(good) + [False] * len(bad)


def test_registry_changes_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    assert W.read(spark, path).count() == 0
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "value string")
    W.append(rows("a", "b", None, " ", "c").repartition(3), path)
    W.append(rows("d"), path)
    lines = lambda **how: sorted(r.value for r in W.read(spark, path, **how).collect())
    assert lines() == ["a", "b", "c", "d"] and lines(version=1) == ["a", "b", "c"] and W.versions(path) == [1, 2]
    # a task that fails leaves everything as it was
    fails = rows("x", "y").repartition(2).selectExpr("if(value = 'y', raise_error('no'), value) as value")
    with pytest.raises(Exception, match="no"):
        W.append(fails, path)
    with pytest.raises(Exception, match="line break"):
        W.append(rows("two\nlines"), path)
    assert lines() == ["a", "b", "c", "d"] and W.versions(path) == [1, 2]
    # so does a writer that another one beat, and a doubled task
    slow = W._Writer(path, False)
    row = lambda x: type("Row", (), {"value": x})()
    first, again = slow.write(iter([row("e")])), slow.write(iter([row("e")]))
    W.append(rows("f"), path)
    with pytest.raises(W.Conflict):
        slow.commit([first, None])
    assert not os.path.exists(f"{tmp_path}/registry/{first.files[0]['name']}")
    second = W._Writer(path, False)
    second.commit([second.write(iter([row("g")]))])
    assert lines() == ["a", "b", "c", "d", "f", "g"] and os.path.exists(f"{tmp_path}/registry/{again.files[0]['name']}")
    rows("z").write.format("registry").mode("overwrite").save(path)
    assert lines() == ["z"] and lines(version=2) == ["a", "b", "c", "d"]
    [f] = W.files_of(path)
    with open(f"{tmp_path}/registry/{f['name']}", "a") as out:
        out.write("more\n")
    with pytest.raises(Exception, match="isn't what was written"):
        lines()


def test_assessments_are_replaced_after_all_are_verified(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    W.replace_verified(table(spark, [record()]), path)
    W.replace_verified(table(spark, [record("https://b.org/y")]), path)
    assert W.read(spark, path).count() == 2 and W.versions(path) == [1, 2]
    for bad, why in ((changed("version", 2), "another version: 1"), (record(), "there twice")):
        with pytest.raises(registries.BadRecords, match=why):
            W.replace_verified(table(spark, [record("https://c.org/"), bad]), path)
    assert W.read(spark, path).count() == 2 and W.versions(path) == [1, 2]
    W.append(table(spark, ["{}"]), path)  # somebody else's line
    with pytest.raises(registries.BadRecords):
        W.replace_verified(table(spark, [record("https://d.org/")]), path)


def test_contracts_take_strict_json_only(spark):
    from ratewright.operators import contracts

    payloads = ['{"a": 1}', '{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1} {}', "oops"]
    raw = spark.createDataFrame([(k, x, hashlib.sha256(x.encode()).hexdigest()) for k, x in enumerate(payloads)], "item_ordinal long, payload_text string, payload_sha256 string")
    rule = [r for r in contracts.RULES if r.name == "exact_payload_hash" and r.model == "raw_item"]
    for k in range(len(payloads)):
        [got] = contracts.evaluate({"raw_item": raw.where(F.col("item_ordinal") == k)}, rule).collect()
        assert got.violations == (k > 0), payloads[k]


def test_a_filter_by_problem_parses_no_line_again(spark):
    found = R.verify(table(spark, [record()])).where("problem is null").groupBy("status").count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "from_json" in x]


def test_a_value_is_written_again_only_where_it_may_lack_bytes(monkeypatch):
    for x in ('{"a":"\\ud800"}', '{"a":"\ud800"}', '{"a":1e999}', '{"a": [-1.5E999]}', "1e999", '{"a":' + "9" * 400 + ".0}", "\ufeff1"):
        with pytest.raises(ValueError):
            C.load(x)
    monkeypatch.setattr(C, "dump", lambda _: pytest.fail("written again"))
    assert C.load(json.dumps(record(inspected=False), ensure_ascii=False)) == record(inspected=False)


def test_members_are_those_of_strict_json_alone(monkeypatch):
    good = record()
    for text in (dump(good), json.dumps(good), json.dumps(good, indent=1), dump({"b": "\u00e9", "a": -1}), "{}"):
        value, members, whole = C.members(text)
        assert value == json.loads(text) and members == {k: dump(x) for k, x in value.items()} and whole == dump(value)
    for bad in ('{"a":1,"a":2}', '{"a":{"b":1,"b":1}}', '{"a":1e5,"a":1}', '{"a":NaN}', '{"a":1e999}', '{"a":"\\ud800"}', '{"a":"\ud800"}', "\ufeff{}", "{} x", "[]", "null", '{"a":01}'):
        with pytest.raises(ValueError):
            C.members(bad)
    monkeypatch.setattr(C, "load", lambda _: pytest.fail("read again"))
    assert C.members('{"b":{"d":1,"c":null},"a":"x"}')[2] == '{"a":"x","b":{"c":null,"d":1}}'
