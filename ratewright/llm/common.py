"""What the operators of this package share: the folder that all machines see, and small DataFrame helpers."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests), one under the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tasks of a stage at most, whatever the input: beyond that, each has more to do, one piece after the other.
TASKS = 20_000

_LOCK = threading.Lock()
#: How many jobs are within, and the settings before, by session.
_INSIDE: dict[int, tuple[int, dict[str, str]]] = {}
#: Rows of an Arrow batch that goes to Python, where nobody chose another number: rows are whole texts, and both sides hold a batch at a time.
BATCH = 1000


@contextmanager
def _tidy(spark: SparkSession, batch: int | None) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends, as its rows are in the shared folder by then (else they stay until the driver collects its garbage), and batches are small.

    Threads may be within at once: the last one out puts back what the first one found.
    """
    cleanup, rows, own = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch", id(spark._jsparkSession)
    with _LOCK:
        n, was = _INSIDE.get(own, (0, {k: spark.conf.get(k, v) for k, v in ((cleanup, "false"), (rows, "10000"))}))
        _INSIDE[own] = n + 1, was
        spark.conf.set(cleanup, "true")
        if batch and was[rows] == "10000":
            spark.conf.set(rows, str(batch))
    try:
        yield
    finally:
        with _LOCK:
            n, was = _INSIDE.pop(own)
            if n > 1:
                _INSIDE[own] = n - 1, was
            else:
                for k, v in was.items():
                    spark.conf.set(k, v)


def cut(df: DataFrame, batch: int | None = BATCH) -> DataFrame:
    """Write the rows to the shared folder and read them from there: lineage ends, and later jobs don't compute them again. batch: None for Spark's own Arrow batches."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with _tidy(df.sparkSession, batch):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, name: str, batch: int | None = BATCH) -> DataFrame:
    """As :func:`cut`, but as a Parquet table of the shared folder, which is smaller."""
    path = scratch(df.sparkSession, name)
    with _tidy(df.sparkSession, batch):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstore(*tables: DataFrame) -> None:
    """Delete the files of tables that nothing will read any more (those that :func:`stored` wrote, found by their paths in the shared folder)."""
    for df in tables:
        spark = df.sparkSession
        root = shared_folder(spark).rstrip("/").removeprefix("file://")
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if root in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, limit: int) -> list | None:
    """The rows, if there are no more than ``limit``; else None, and the caller joins instead."""
    found = df.limit(limit + 1).collect()
    return found if len(found) <= limit else None


def unsigned32(c: Column) -> Column:
    return F.when(c < 0, c + F.lit(1 << 32)).otherwise(c)
