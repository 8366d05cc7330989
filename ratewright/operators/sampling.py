"""A seeded sample without replacement: the draw of Python's ``random.Random(seed).sample`` over the keys in ascending order."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks


def seeded(frame: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """The drawn rows and ``drawn``, their place in the draw. Keys must be different.

    Only positions are drawn on the driver; rows get theirs from a sort by range and the sizes of its parts, and never leave their tasks.
    """
    n = frame.count()
    spark = frame.sparkSession
    positions = random.Random(seed).sample(range(n), size)
    wanted = spark.createDataFrame([(p, k) for k, p in enumerate(positions)] or [(-1, -1)], "place_ bigint, drawn bigint")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n))
    placed = frame.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("id_", F.monotonically_increasing_id())
    path = sinks.scratch(spark, "sampling-frame")
    placed.write.parquet(path)  # places are given once
    placed = spark.read.schema(placed.schema).parquet(path)
    part, own = F.shiftright("id_", 33), F.col("id_").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.select(*frame.columns, part.alias("part_"), own.alias("own_"))
    sizes = placed.groupBy("part_").agg(F.count("*").alias("n_"))  # as many rows as there are parts
    before = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = placed.join(F.broadcast(before.select("part_", "before_")), "part_").withColumn("place_", F.col("before_") + F.col("own_"))
    return met.join(F.broadcast(wanted), "place_").select(*frame.columns, "drawn")


def frame(units: DataFrame, kinds: Column, places: Column, *more: Column) -> DataFrame:
    """The units that a sample may be drawn from: of the right kind and place, and whatever else must hold; an unknown is a no."""
    keep = kinds & places
    for m in more:
        keep &= m
    return units.where(F.coalesce(keep, F.lit(False)))
