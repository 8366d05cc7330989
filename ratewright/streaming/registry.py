"""A registry of assessments, one JSON object a line, followed as a stream.

Files are only ever appended to the folder. Records come once each: by ``assessment_id``, remembered within the watermark of the time they
were observed, so that state stays bounded however long the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "assessment_id string, as_of string, observed_at timestamp, publisher string, grade string"


def records(spark: SparkSession, folder: str, schema: str = RECORD, late: str = "7 days") -> DataFrame:
    """A streaming DataFrame of the registry's records; lines that aren't records are left out."""
    lines = spark.readStream.format("text").load(folder)
    parsed = lines.select(F.from_json("value", schema).alias("r")).select("r.*").where("assessment_id is not null and observed_at is not null")
    return parsed.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["assessment_id"])


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Write the records as Parquet by day; each batch is written under its id, so a batch that runs twice counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
