"""Files as tables: binary images, feature tables, caches, findings, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.versions import cache_key

#: Suffixes that are no images (fixed values).
NOT_IMAGES = [".html", ".pdf", ".conf", ".txt", ".md", ".csv", ".json", ".zip", ".exe", ".msi", ".mib", ".xml"]
MAX_BYTES = 268_435_456
STATES = ["cve_encontrada", "produto_encontrado_sem_cve", "nao_encontrado"]
CACHE_VERSION = 4
CACHE_ENTRY = (
    "struct<schema_version: int, fetched_at: string, queries: array<struct<variant: string, endpoint: string, total: bigint, fetched_at: string>>, "
    "cpe_candidates: array<string>, evidence_state: string, source: string, vendor: string, model: string, cpe_name: string, "
    "cves: array<struct<id: string, cvss_max: double, severity: string, configurations: string>>>"
)
FINDING = "firmware_id string, path string, type string, source string, context string, confidence string, detector string, detector_version string, line long"
PROVENANCE = "firmware_id string, in_table boolean, aliases array<struct<meta_path: string, vendor: string, model: string>>"


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def firmware_files(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES, allowed: list[str] | None = None) -> DataFrame:
    """(path, file_size, content, truncated) of the images under a folder, dot files
    and other suffixes left out; content is cut at max_bytes. allowed: only these
    suffixes instead. Spark lists no empty files; unreadable ones are skipped by the session's setting for
    corrupt files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = suffix_of(name).isin(*allowed) if allowed else ~suffix_of(name).isin(*NOT_IMAGES)
    kept = files.where(wanted & ~name.startswith("."))
    return kept.select(
        "path",
        F.col("length").alias("file_size"),
        F.substring(F.coalesce("content", F.lit(b"")), 1, max_bytes).alias("content"),
        (F.col("length") > max_bytes).alias("truncated"),
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV table by its suffix."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    raise ValueError(f"neither Parquet nor CSV: {path}")


def read_text_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns as text, so that a version 1.10 stays one; missing ones are an error."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, entry fields) of a JSON object of entries by vendor/model; the
    configurations of each vulnerability stay JSON.
    """
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", f"map<string, {CACHE_ENTRY}>")).alias("key", "e"))
    return entries.select("key", "e.*")


def cache_violations(entries: DataFrame) -> DataFrame:
    """(key, problems array): entries that labelling can't use."""
    tests = {
        "cves": F.col("cves").isNull(),
        "schema_version": ~F.coalesce(F.col("schema_version") == CACHE_VERSION, F.lit(False)),
        "fetched_at": F.coalesce(F.trim("fetched_at"), F.lit("")) == "",
        "queries": F.col("queries").isNull(),
        "cpe_candidates": F.col("cpe_candidates").isNull(),
        "evidence_state": ~F.coalesce(F.col("evidence_state").isin(*STATES), F.lit(False)),
    }
    problems = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return entries.select("key", problems.alias("problems")).where(F.size("problems") > 0)


def cached_cves(entries: DataFrame) -> DataFrame:
    """(key, nth, cve_id, score, severity, configurations)."""
    rows = entries.select("key", F.posexplode("cves").alias("nth", "c"))
    return rows.select("key", "nth", F.col("c.id").alias("cve_id"), F.col("c.cvss_max").alias("score"), F.col("c.severity").alias("severity"), F.col("c.configurations").alias("configurations"))


def with_cache_key(df: DataFrame, brand: str = "meta_brand", model: str = "meta_model") -> DataFrame:
    return df.withColumn("key", cache_key(F.col(brand), F.col(model)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of text files with their numbers, from 1.

    Files are read in blocks as ever. The lines of a block are consecutive in its task, so
    a line's number is its place there and the lines of the blocks before: a sum over a row
    for each block. A line may end in \\n, \\r\\n or \\r; an empty one counts.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line_no"), "value")


def read_findings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Findings with the file and number of their lines, and the lines that aren't findings
    (file, line_no, bad). An empty line is none.
    """
    read = F.from_json("value", f"{FINDING}, bad string", {"columnNameOfCorruptRecord": "bad"})
    lines = numbered_lines(spark, path).withColumn("f", read)
    right = F.col("f.detector").isNotNull() & F.col("f.bad").isNull()
    return lines.where(right).select("file", "line_no", "f.*").drop("bad"), lines.where(~F.coalesce(right, F.lit(False))).select("file", "line_no", F.col("value").alias("bad"))


def check_findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings of path; an error that names the first line that is none."""
    found, bad = read_findings(spark, path)
    if first := bad.orderBy("file", "line_no").first():
        raise ValueError(f"no finding in {first['file']}:{first['line_no']}")
    return found


def read_provenance(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(firmware_id, meta_path, vendor, model) of what is in the table, and rows
    without vendor or model.
    """
    kept = spark.read.schema(PROVENANCE).json(path).where("in_table").select("firmware_id", F.explode("aliases").alias("a")).select("firmware_id", "a.*")
    blank = (F.coalesce(F.trim("vendor"), F.lit("")) == "") | (F.coalesce(F.trim("model"), F.lit("")) == "")
    return kept.where(~blank), kept.where(blank)


def read_run(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """The predictions of a stored run; an id is 64 hex digits and so never a path."""
    import re

    if not re.fullmatch(r"[0-9a-f]{64}", run_id):
        raise ValueError(f"no run id: {run_id!r}")
    return spark.read.parquet(f"{folder}/{run_id}/predictions.parquet")
