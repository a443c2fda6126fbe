"""Writing tables with manifests that are published last and never overwritten."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_digest(df: DataFrame) -> str:
    """A hash of the rows of a table in any order, whatever files hold them."""
    h = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")) for i in (1, 13, 25, 37, 49)]
    row = df.agg(F.count(F.lit(1)), *parts).first()
    return hashlib.sha256(":".join(map(str, row)).encode()).hexdigest()


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet, CSV or JSON lines by the suffix."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if path.endswith(".csv"):
        writer.csv(path, header=True)
    elif path.endswith(".jsonl"):
        writer.json(path)
    else:
        writer.parquet(path)


def write_findings(findings: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """JSON lines with a line number for each finding by order, as files keep none.
    Numbers are ranks within (firmware_id, path), so no task sees them all.
    """
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("firmware_id", "path").orderBy(*order))
    write_table(findings.withColumn("line", nth.cast("long")), path, overwrite)


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """A small table as one sorted CSV file with six digits."""
    kinds = dict(df.dtypes)
    shown = [F.format_string("%.6f", F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    df.orderBy(*order).select(*shown).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm


def write_manifest(spark: SparkSession, path: str, manifest: dict, overwrite: bool = False) -> None:
    """A JSON file in any store that Spark writes; an existing one is an error."""
    files, place, _ = _hadoop(spark, path)
    out = files.create(place, overwrite)
    out.write(bytearray(json.dumps(manifest, sort_keys=True, ensure_ascii=False, indent=1).encode()))
    out.close()


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _written_digest(spark: SparkSession, path: str) -> str:
    """The digest of what was written: rows of Parquet, lines of text."""
    return row_digest(spark.read.text(path) if path.endswith((".csv", ".jsonl")) else spark.read.parquet(path))


def publish(tables: dict[str, DataFrame], folder: str, manifest: dict, overwrite: bool = False) -> dict:
    """All tables into a folder beside the target, the manifest with their digests
    last, then one rename; an existing target is an error unless overwrite.
    """
    spark = next(iter(tables.values())).sparkSession
    files, target, jvm = _hadoop(spark, folder)
    if files.exists(target) and not overwrite:
        raise FileExistsError(folder)
    staging = f"{folder}.staging"
    files.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    digests = {}
    for name, df in tables.items():
        write_table(df, f"{staging}/{name}", overwrite=True)
        digests[name] = _written_digest(spark, f"{staging}/{name}")
    told = manifest | {"digests": digests}
    write_manifest(spark, f"{staging}/manifest.json", told, overwrite=True)
    # The old tables are deleted when the new ones stand in their place.
    old = jvm.org.apache.hadoop.fs.Path(f"{folder}.old")
    if files.exists(target):
        files.delete(old, True)
        if not files.rename(target, old):
            raise OSError(f"can't move {folder} aside")
    if not files.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"can't move {staging} to {folder}")
    files.delete(old, True)
    return told


def check_published(spark: SparkSession, folder: str) -> dict:
    """The manifest, if the tables still have its digests."""
    manifest = read_manifest(spark, f"{folder}/manifest.json")
    for name, digest in manifest["digests"].items():
        if _written_digest(spark, f"{folder}/{name}") != digest:
            raise ValueError(f"{name} has changed since it was published")
    return manifest


def run_id(parts: dict) -> str:
    """The id of a run: SHA-256 of its canonical JSON."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
