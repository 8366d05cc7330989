"""A run of the charge pipeline: contracts first, then partitioned Parquet under the run's id, then a manifest.

All tables of a run are written to a staging folder of the attempt's own, counted and timed on the way; their files are hashed, and only then are they moved to their places,
all of them or none, never onto anything that is there. The manifest, with every file's digest, comes last, and a run without one can't be read.

Tables are written under ``<root>/<layer>/<model>/publisher_id=/period=/file_version=/run_id=``, so that a run is a set of partitions:
readers prune to it. What a run is follows from its inputs and from the fingerprint of the model, so an unchanged run is found and reused.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Mapping
from datetime import date, datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import digest, dump, seal, sealed
from ..operators import contracts
from ..sources import snapshots

LAYERS = {
    "raw_item": "raw", "raw_modifier": "raw", "charge_item": "staging", "charge_code": "staging", "charge_group": "staging", "charge_modifier": "staging", "payer_rate": "staging", "modifier": "staging", "modifier_payer": "staging",
    "observation": "intermediate", "file_finding": "mart", "file_profile": "mart", "dollar_mart": "mart",
}
PARTITIONS = ["publisher_id", "period", "file_version", "run_id"]


def model_fingerprint() -> str:
    return digest({"layers": LAYERS, "rules": [f"{r.model}.{r.name}" for r in contracts.RULES], "partitions": PARTITIONS})


def run_id(publisher: str, source_sha256: str, as_of: date) -> str:
    return hashlib.sha256("\0".join([publisher, source_sha256, as_of.isoformat(), model_fingerprint()]).encode()).hexdigest()


def _manifests(spark: SparkSession, root: str, run: str) -> list[dict]:
    path = f"{root}/manifests/{run}"
    if not _exists(spark, path):
        return []
    return [json.loads(r.value) for r in spark.read.text(path).collect()]  # one line


class NotVisible(ValueError):
    """A run that was never completed, or that isn't there."""


def _place(spark: SparkSession, model: str, keys: Mapping[str, str]) -> str:
    return f"{LAYERS[model]}/{model}/" + "/".join(f"{k}={_escaped(spark, keys[k])}" for k in PARTITIONS)


def _listed(spark: SparkSession, root: str, folders: list[str]) -> list[tuple[str, int]]:
    """Paths below ``root`` and sizes of the data files in some folders; names only, nothing is read."""
    found = []
    for folder in folders:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(hadoop):
            found += [(f"{folder}/{f.getPath().getName()}", f.getLen()) for f in system.listStatus(hadoop) if not f.getPath().getName().startswith(("_", "."))]
    return found


def _artifacts(spark: SparkSession, root: str, files: list[tuple[str, int]]) -> list[dict]:
    """Each file's path, bytes and SHA-256, of its bytes as they are: files are hashed in parallel, no row is decoded."""
    if not files:
        return []
    uri = lambda path: f"{root}/{quote(path)}"
    digests = snapshots.digests(spark.createDataFrame([(uri(path), size) for path, size in files], "file string, size bigint"))
    have = {r.file: r for r in digests.collect()}  # a line for each file of one run, as its manifest has
    return [{"path": path, "bytes": size, "sha256": have[uri(path)].sha256} for path, size in sorted(files)]


def existing(spark: SparkSession, root: str, run: str) -> dict | None:
    """The manifest of a run that was completed, if its seal and every byte of its files still hold."""
    found = _manifests(spark, root, run)
    if not found:
        return None
    [manifest] = found
    if not sealed(manifest):
        raise ValueError(f"the manifest of run {run} was changed")
    want = {a["path"]: a for a in manifest["artifacts"]}
    files = _listed(spark, root, [_place(spark, m, manifest) for m in manifest["counts"]])
    # names and sizes first: most changes show without reading anything
    wrong = {p for p in {*want, *(p for p, _ in files)} if want.get(p, {}).get("bytes") != dict(files).get(p)}
    if not wrong:
        wrong = {a["path"] for a in _artifacts(spark, root, files) if a != want[a["path"]]}
    if wrong:
        raise ValueError(f"files of run {run} aren't those of its manifest: {', '.join(sorted({p.split('/')[1] for p in wrong}))}")
    return manifest


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Never onto something that is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(path(target)):
        raise FileExistsError(f"refusing to overwrite {target}")
    system.mkdirs(path(target).getParent())
    if not system.rename(path(source), path(target)):
        raise OSError(f"could not move {source} to {target}")


def _promote(spark: SparkSession, staging: str, root: str, places: Mapping[str, str]) -> None:
    """Move every model to its place, or none: what was moved goes back to staging if a later one fails."""
    moved: list[str] = []
    try:
        for model, place in places.items():
            _rename(spark, f"{staging}/{place}", f"{root}/{place}")
            moved.append(place)
    except BaseException:
        for place in reversed(moved):
            _rename(spark, f"{root}/{place}", f"{staging}/{place}")
        raise


def write(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, publisher: str, period: date, version: str, source_sha256: str, as_of: date) -> dict:
    """Enforce the contracts, write a run and measure it; an equal run that is there already is returned instead, without reading a row.

    What a run that was stopped before its manifest left behind was never visible (:func:`read` asks for the manifest) and is deleted first.
    """
    run = run_id(publisher, source_sha256, as_of)
    if found := existing(spark, root, run):
        return found | {"reused": True}
    contracts.enforce_types(tables)
    contracts.enforce(tables)
    keys = {"publisher_id": publisher, "period": period.isoformat(), "file_version": version, "run_id": run}
    models = [m for m in LAYERS if m in tables]
    places = {m: _place(spark, m, keys) for m in models}
    for place in places.values():
        _delete(spark, f"{root}/{place}")
    staging, measured = f"{root}/_staging/{run}-{uuid.uuid4().hex}", []
    try:
        for model in models:
            began, seen = time.monotonic(), Observation(model)
            rows = tables[model].observe(seen, F.count(F.lit(1)).alias("rows"))
            rows.write.option("compression", "zstd").parquet(f"{staging}/{places[model]}")
            measured.append((model, seen.get["rows"], int(1000 * (time.monotonic() - began))))
        artifacts = _artifacts(spark, staging, _listed(spark, staging, list(places.values())))
        _promote(spark, staging, root, places)
    finally:
        _delete(spark, staging)
    counts = {m: n for m, n, _ in measured}
    manifest = seal({**keys, "as_of": as_of.isoformat(), "source_sha256": source_sha256, "model": model_fingerprint(), "counts": counts, "artifacts": artifacts})
    sizes = {m: sum(a["bytes"] for a in artifacts if a["path"].startswith(place + "/")) for m, place in places.items()}
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    snapshots.record_metrics(spark.createDataFrame([(run, m, LAYERS[m], n, None, None, sizes[m], ms, now) for m, n, ms in measured], snapshots.METRIC), root)
    spark.createDataFrame([(dump(manifest),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{root}/manifests/{run}")
    return manifest | {"reused": False}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as Spark writes it in paths."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read(spark: SparkSession, root: str, model: str, run: str) -> DataFrame:
    """A table of a run that was completed."""
    if not _exists(spark, f"{root}/manifests/{run}"):
        raise NotVisible(f"there is no completed run {run}")
    return spark.read.parquet(f"{root}/{LAYERS[model]}/{model}").where(F.col("run_id") == run)
