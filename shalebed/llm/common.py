"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that separates words in the contracts: ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Stands for a null doc_id wherever documents are ordered or counted.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone.

    A text of one byte per character is ASCII, where the built-in lower() does
    the same in one pass over its bytes.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_white(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text that has no null.

    Replacing and splitting by single characters stays clear of regular
    expressions, which take three times as long here.
    """
    for c in WHITE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def wide_hash(*columns: Column) -> list[Column]:
    """128 bits in two long columns; 64 bits alone collide at 10^10 keys."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(0x9E3779B9), *columns).alias("h2")]


def extended(df: DataFrame, columns: str) -> T.StructType:
    """The schema of df with more columns; df.schema itself stays as it is."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(columns).fields])


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and
    all of Spark is this process.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, for rows with texts."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
