"""Cutting lineage in the shared folder of the session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; in a folder of our own only where
    that is unset and all of Spark is this process.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the place of each row by order, from 0. Ranges are sorted each in a
    task of its own; only the number of rows of each goes over the driver.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ranges.withColumn("__id", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__id", 33))
    before, offsets = 0, []
    for r in placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect():
        offsets.append((r["__range"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(offsets, "__range long, __before long")
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "__range").withColumn(name, place).drop("__id", "__range", "__before")
