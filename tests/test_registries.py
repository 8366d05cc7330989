import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ratewright.operators import sampling, scorecard
from ratewright.sources import snapshots as S

def test_seeded_sample_is_pythons(spark):
    ids = random.Random(1).sample(range(10**6), 500)
    got = sampling.seeded(spark.createDataFrame([(f"{i:07d}", i) for i in ids], "id string, n long"), "id", 20260819, 48)
    assert [r.id for r in got.orderBy("drawn").collect()] == random.Random(20260819).sample(sorted(f"{i:07d}" for i in ids), 48)


def test_snapshots_and_metrics(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one")
    (tmp_path / "b").write_bytes(b"two" * 10**6)
    digest = lambda n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()
    files = spark.createDataFrame([(f"file://{tmp_path}/a", digest("a")), (f"file://{tmp_path}/b", None)], "path string, sha256 string")
    got = S.snapshot(files, f"file://{tmp_path}/kept").collect()
    assert {r.sha256: r.size for r in got} == {digest("a"): 3, digest("b"): 3 * 10**6} and sorted(p.name for p in (tmp_path / "kept").iterdir() if not p.name.startswith(".")) == sorted([digest("a"), digest("b")])
    with pytest.raises(S.Changed, match="1 files changed"):
        S.snapshot(files.withColumn("sha256", F.when(F.col("sha256").isNotNull(), "0" * 64)), f"file://{tmp_path}/other")
    row = lambda n, t: ("r", "m", "mart", n, 0, 0, 0, 0, t)
    for n, t in ((5, "2026-01-01"), (9, "2026-01-03"), (7, "2026-01-02")):
        S.record_metrics(spark.createDataFrame([row(n, t)], S.METRIC.replace("timestamp", "string")).withColumn("measured_at", F.to_timestamp("measured_at")), f"file://{tmp_path}/m")
    assert [r.rows_produced for r in S.metrics(spark, f"file://{tmp_path}/m").collect()] == [9]


def test_refused_compositions(spark):
    retrievals = spark.createDataFrame([(1, 7, "l", "u", "u", "2026-08-01T00:00:00Z", "fetched", 200, 1, None, "d", 5, None, None)], "file_id long, publisher_id long, location_id string, requested_url string, url string, attempted_at string, status string, http_status int, attempts int, error string, content_sha256 string, size_bytes long, content_type string, problems array<string>")
    inspections = spark.createDataFrame([(1, "other", 5, "2026-08-01", 7, True, 3)], "file_id long, source_sha256 string, source_size long, inspected_as_of string, inspected_publisher long, scan_completed boolean, items long").withColumn("inspected_as_of", F.to_date("inspected_as_of"))
    with pytest.raises(scorecard.NotComposed, match="other bytes were inspected: 1"):
        scorecard.require_composed(scorecard.compose(retrievals, inspections))
    assert scorecard.require_composed(scorecard.compose(retrievals, inspections.withColumn("source_sha256", F.lit("d")))) is None
