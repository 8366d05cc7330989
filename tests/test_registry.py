import json

from ratewright.streaming import registry


def test_records_come_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    line = lambda k, day: json.dumps({"assessment_id": f"a{k}", "as_of": day, "observed_at": f"{day}T10:00:00Z", "publisher": "p", "grade": "A"})

    def run():
        q = registry.append_to(registry.records(spark, str(folder)), out, str(tmp_path / "checkpoint"))
        q.awaitTermination(90)

    (folder / "1.jsonl").write_text("\n".join([line(1, "2026-08-01"), line(2, "2026-08-01"), line(1, "2026-08-01"), "not a record"]))
    run()
    (folder / "2.jsonl").write_text("\n".join([line(2, "2026-08-01"), line(3, "2026-08-02")]))
    run()
    assert sorted(r.assessment_id for r in spark.read.parquet(out).collect()) == ["a1", "a2", "a3"]
