from pyspark.sql import functions as F

from ratewright.operators import normalize
from ratewright.plans import faults
from ratewright.plans.bridge import Tables
from ratewright.sources import sinks
from ratewright.sources.charge_json import SCHEMA, ChargeJson


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_written_as_their_rows_come(spark, tmp_path):
    rows = [("7", 0, '{"a":1}'), ("7", 0, None), ("7", 0, '{"a":2}'), ("8", 1, None), ("9", 0, '{"é":3}')]
    texts = spark.createDataFrame(rows, "name string, frame int, text string").coalesce(1)
    frames = {0: ('{"standard_charge_information":[', "]}\n", "utf-8"), 1: ("{", "}\n", "utf-8")}
    assert sinks.write_documents(texts, str(tmp_path / "plain"), frames, ",") == 3
    assert {p.name: p.read_text() for p in (tmp_path / "plain").iterdir()} == {"7": '{"standard_charge_information":[{"a":1},{"a":2}]}\n', "8": "{}\n", "9": '{"standard_charge_information":[{"é":3}]}\n'}
    sinks.write_documents(texts, str(tmp_path / "packed"), frames, ",", compression="zstd")
    spark.dataSource.register(ChargeJson)
    read = lambda name, **options: sorted((r.part, r.ordinal or 0, r.payload_text or "") for r in spark.read.format("charge_json").options(**options).load(str(tmp_path / name)).collect())
    assert read("packed", compression="zstd") == read("plain")


def test_only_keys_of_lines_are_shuffled(spark, sf):
    """F8, F11, F13, F14: texts are made after the one shuffle."""
    for texts in (faults.json_texts, faults.csv_texts):
        above, below = plan(texts(Tables(spark, sf).lineitem)).split("RepartitionByExpression")
        assert "line @" in above and "line @" not in below


def test_payloads_are_parsed_once(spark):
    """one parse of items and one of modifiers, whatever the number of levels."""
    rows = spark.createDataFrame([], SCHEMA).withColumn("file_id", F.lit(1))
    assert plan(normalize.type_errors(rows)).count("parse_json") + plan(normalize.type_errors(rows)).count("parseJson") <= 2


def test_texts_of_elements_stay_out_of_the_envelope(spark):
    """F8: rows that an aggregate may sort by file are light."""
    rows = spark.createDataFrame([("f", "envelope", "version", None, '"3"', None, False), ("f", "standard_charge_information", None, 0, "{}" * 99, None, False), ("f", "source", "sha256", 9, "ab", None, None)], SCHEMA).withColumn("file_id", F.lit(1))
    assert "CASE WHEN part" in plan(normalize.envelope(rows)).split("Aggregate")[1].split("\n", 1)[1]
    [e] = normalize.envelope(rows).collect()
    assert (e.fields, e.items, e.source_sha256, e.source_size) == ({"version": '"3"'}, 1, "ab", 9)
