"""The detector scan over a stream of documents.

A document is a row, and its counts depend on that row only, so the stream has no
state and takes any trigger; results are appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import printable_runs
from ..operators.detectors import SCANNED


def counts_of(text: Column) -> dict[str, Column]:
    """The counts and flags of a text by expressions of its strings."""
    strings = F.transform(printable_runs(text), lambda s: F.struct(s.alias("s")))
    out = {}
    for d in SCANNED:
        total = F.aggregate(F.transform(strings, _size_of(d)), F.lit(0), lambda t, n: t + n)
        out[d.column] = total.cast("long") if d.reduces == "count" else total > 0
    return out


def _size_of(detector):
    return lambda x: F.size(detector.build(x["s"]))


def scan_stream(stream: DataFrame, key: str, text: str = "text") -> DataFrame:
    return stream.select(key, *[c.alias(n) for n, c in counts_of(F.col(text)).items()])


def run_scan(spark: SparkSession, source: DataFrame, key: str, target: str, checkpoint: str) -> DataFrame:
    """Scans what a stream has now into a Parquet folder, exactly once, and reads it."""
    query = scan_stream(source, key).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)
