import json
import os
import time

from pyspark.sql import functions as F

from ratewright.functions import text
from ratewright.operators import inspect_csv, normalize, rates
from ratewright.plans import queries
from ratewright.plans.bridge import Tables

ODD = [
    {"description": "a", "standard_charges": [{"setting": "both", "billing_class": 5, "payers_information": [{"payer_name": "P", "plan_name": "Q", "methodology": "other", "standard_charge_dollar": 1.50, "standard_charge_percentage": "3", "standard_charge_algorithm": " ", "10th_percentile": 10**20, "count": "11"}, 7, None, {}, {"standard_charge_dollar": True, "standard_charge_algorithm": {"a": 1}, "standard_charge_percentage": [1]}]}, "none", {"setting": " ", "payers_information": {}}, {"setting": "inpatient", "billing_class": "x", "payers_information": [{"standard_charge_percentage": 1e3}]}]},
    {"standard_charges": None},
    {"standard_charges": [{"payers_information": []}]},
    {"standard_charges": {"payers_information": [{}]}},
    {},
]


def test_payer_rates_with_their_groups_are_those_of_the_joined_tables(spark):
    rows = spark.createDataFrame([("f", "standard_charge_information", None, k, json.dumps(x), None, False) for k, x in enumerate(ODD)], "file_id string, part string, name string, ordinal long, payload_text string, problem string, bom boolean")
    m = normalize.normalize(rows)
    one = normalize.payer_rates_of_groups(normalize.items(rows))
    want = m["payer_rate"].join(m["charge_group"].select("charge_group_id", "setting", "billing_class"), "charge_group_id")
    told = lambda df: sorted(map(str, df.select(*sorted(one.columns)).collect()))
    assert told(one) == told(want) and one.count() == 6
    seen, joined = rates.stated(one), rates.observations(m["payer_rate"], m["charge_group"])
    assert sorted(map(str, seen.collect())) == sorted(map(str, joined.select(*seen.columns).collect()))
    plan = seen.groupBy("methodology").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_charge_documents_take_little_disk(spark, sf):
    t = Tables(spark, sf)
    rows = queries.json_rows(t).select("file", "part", "ordinal", "payload_text", "problem").collect()
    items = [r for r in rows if r.part == "standard_charge_information"]
    assert sorted(json.loads(r.payload_text)["description"] for r in items) == sorted(r[0] for r in t.payer_rate.join(t.charge_group, "charge_group_id").select("payer_rate_id").collect())
    assert not [r for r in rows if r.problem] and {r.file for r in items} == {r.file for r in rows}
    disk = sum(os.path.getsize(file.removeprefix("file://")) for file in {r.file for r in rows})
    assert disk * 5 < sum(r.ordinal for r in rows if r.part == "source")


def test_charge_documents_are_the_same_in_parts(spark, sf, monkeypatch):
    told = lambda: sorted(r.payload_text for r in queries.json_rows(Tables(spark, sf)).where("part = 'standard_charge_information'").select("payload_text").collect())
    whole = told()
    monkeypatch.setattr(queries, "LINES", len(whole) // 3)
    assert told() == whole


def test_lines_of_charge_documents_are_shuffled_once(spark, sf):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # suppliers are broadcast, orders aren't
    try:
        own = queries.charges_part(Tables(spark, sf), 0, 1, 8)
        plan = own.payer_rate.join(own.charge_group.select("charge_group_id", "setting"), "charge_group_id")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastHashJoin" in plan and "SortMergeJoin" in plan  # one of the lines, one of the orders
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_shuffle_files_of_charge_documents_go(spark, sf):
    files = lambda: {f for _, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_")}
    earlier = files()
    queries.json_rows(Tables(spark, sf))
    end = time.monotonic() + 10
    while (left := files() - earlier) and time.monotonic() < end:
        time.sleep(0.1)
    assert left == set() and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_no_lines_give_no_documents(spark, sf, tmp_path):
    for name in ("lineitem", "orders", "supplier"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert queries.QUERIES["json_round_trip"](spark, str(tmp_path)).collect() == []


def test_scores_of_a_task_are_bounded(spark):
    passages = spark.range(60).select(F.col("id").alias("passage_id"), F.concat(F.lit("rate of charge "), F.col("id") % 7).alias("text"))
    queries = spark.range(10).select(F.col("id").alias("query_id"), F.concat(F.lit("charge "), F.col("id") % 5).alias("text"))
    whole, cut = text.bm25(passages, queries, 3), text.bm25(passages, queries, 3, pairs=10)
    assert sorted(whole.collect()) == sorted(cut.collect()) and whole.count() == 30
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [passage_id#" in plan and "], 60" in plan


def test_blank_cells(spark):
    cells = ["", " ", "\t\n", "\u00a0\u2003", "\u3000x", "x", " x", "\u00e9", "\x00", "\x7f", "~", "!", "\u200b", "\ufeff", None]
    df = spark.createDataFrame(list(enumerate(cells)), "k int, c string")
    want = {k: bool(c is not None and c.strip() if c not in ("\x1c",) else False) for k, c in enumerate(cells)}
    assert {r.k: r.f for r in df.select("k", inspect_csv.filled(F.col("c")).alias("f")).collect()} == want


def test_header_places_are_worked_out_once_for_a_file(spark):
    assert "array_position" not in str(inspect_csv._named("setting")) and "array_position" in str(inspect_csv._places())
