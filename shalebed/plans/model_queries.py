"""Queries of names, streams and models."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import functions as F

from ..functions import versions
from ..functions.byte_stats import byte_features
from ..functions.storage import checkpointed
from ..operators import elf, extra_trees, groups, importance, metrics, models
from ..sources.tables import table
from ..streaming.scan import run_scan
from .detector_queries import counts_sql
from .text_queries import RUNS

FILES = [
    ("asus", "'FW_RT-AC' || p_size || '_3004.zip'", "'rt-ac' || p_size"),
    ("asus", "'FW_XG' || p_size || '_1.0.zip'", "NULL"),
    ("asus", "'Asus-rtn' || p_size || '-webflash.bin'", "'rtn' || p_size"),
    ("tp_link", "'Archer C' || p_size || ' V2_x.zip'", "'archer-c' || p_size || '-v2'"),
    ("tp_link", "'TL-WR' || p_size || 'N_V1.zip'", "'tl-wr' || p_size || 'n'"),
    ("netgear", "'R' || (6000 + p_size) || '-V1.0.1.zip'", "'r' || (6000 + p_size)"),
    ("dlink", "'DIR' || p_size", "NULL"),
]


def q_model_of_file(spark, sf):
    rows = F.array(*[F.struct(F.lit(v).alias("vendor"), F.expr(n).alias("name")) for v, n, _ in FILES])
    named = table(spark, sf, "part").select("p_partkey", F.inline(rows))
    return named.select("p_partkey", "name", versions.model_of_file(F.col("vendor"), F.col("name")).alias("model"))


def q_resolved_product(spark, sf):
    cpe = lambda part, product: F.concat(F.lit(f"cpe:2.3:{part}:acme:"), product, F.lit(":1.0:*:*:*:*:*:*:*"))
    m = F.concat(F.lit("m"), "p_size")
    names = F.array(
        F.when(F.col("p_size") % 3 == 0, cpe("o", F.concat(m, F.lit("_firmware")))),
        F.when(F.col("p_size") % 5 == 0, cpe("o", F.concat(m, F.lit("-firmware")))),
        F.when(F.col("p_size") % 2 == 0, cpe("h", m)),
        cpe("h", F.lit("other")),
    )
    p = table(spark, sf, "part").select("p_partkey", versions.resolved_product(F.filter(names, lambda x: x.isNotNull()), F.lit("Acme"), m).alias("r"))
    return p.select("p_partkey", F.col("r.cpe_name").alias("cpe_name"), F.size("r.accepted").cast("long").alias("n_accepted"))


def q_stream_counts(spark, sf):
    """The scan of documents as a stream that takes all there is."""
    checkpointed(spark.range(1))  # sets a folder where the session has none
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "documents").schema
    source = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")  # a pattern, so that one file will do as well as a folder
    return run_scan(spark, source.withColumn("key", F.col("doc_id").cast("string")), "key", f"{folder}/out", f"{folder}/state")


def _elf(kind: int, machine: int) -> bytes:
    """A header of a 32-bit little-endian ELF file without segments."""
    return b"\x7fELF\x01\x01\x01" + b"\0" * 9 + struct.pack("<HHIIIIIHHHHHH", kind, machine, 1, 0, 52, 0, 0, 52, 32, 0, 40, 0, 0)


def q_filesystem_features(spark, sf):
    """Images by size of part: programs, one library many times, broken headers, texts, and in
    some a file that can't be read.
    """
    k = F.col("p_partkey")
    tail = F.encode(k.cast("string"), "UTF-8")
    content = (
        F.when((F.col("p_size") % 7 == 0) & (k % 11 == 0), F.lit(None).cast("binary"))
        .when(k % 4 == 0, F.concat(F.when(k % 3 == 0, F.lit(_elf(2, 8))).otherwise(F.lit(_elf(2, 40))), tail))
        .when(k % 4 == 1, F.lit(_elf(3, 40)))
        .when(k % 4 == 2, F.concat(F.lit(b"\x7fELF\x01\x01"), tail))
        .otherwise(tail)
    )
    path = F.concat(F.when(k % 5 == 0, "other/bin/f").otherwise("squashfs-root/bin/f"), k)
    told = elf.filesystem_features(table(spark, sf, "part").select(F.col("p_size").alias("firmware_id"), path.alias("path"), content.alias("content")))
    return told.select(
        "firmware_id", "fs_status", "fs_error", "unpacked_n_files", "unpacked_n_elf", "unpacked_n_elf_exec", "unpacked_n_elf_lib", "unpacked_n_elf_static", "fs_elf_malformed",
        F.col("fs_arch").cast("long").alias("fs_arch"), F.round("unpacked_prop_nx", 6).alias("prop_nx"), F.round("unpacked_prop_pie", 6).alias("prop_pie"),
    )


def _labelled(spark, sf):
    # Features go to the labels, not texts.
    features = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("/", "source", F.col("doc_id") % 5).alias("group"), F.length("text").alias("n_chars"), F.regexp_count("text", F.lit("[$%#&*]")).alias("n_symbols"),
        F.size(F.array_distinct(F.split("text", " "))).alias("n_distinct"), F.lit(1).alias("constant"),
        byte_features(F.encode("text", "UTF-8")).alias("b"),
    )
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("y"))
    return features.select("*", "b.entropy", "b.byte_mean").drop("b").join(labels, "doc_id")


FEATURES = ["n_chars", "n_symbols", "n_distinct", "constant", "entropy", "byte_mean"]


def _out_of_fold(spark, sf):
    d = checkpointed(_labelled(spark, sf))
    folds = checkpointed(groups.grouped_folds(d, "doc_id", "group", "y", 3, seed=1))
    return d, folds, models.out_of_fold(d, folds, "doc_id", FEATURES, "y", ["0", "1"], trees=20, depth=5)


def q_out_of_fold(spark, sf):
    return _out_of_fold(spark, sf)[2]


def q_out_of_fold_metrics(spark, sf):
    """The forest and the majority baseline on the same folds."""
    d, folds, forest = _out_of_fold(spark, sf)
    both = forest.select("repeat", "y_true", "y_pred").withColumn("arm", F.lit("forest")).unionByName(
        models.majority_baseline(d, folds, "doc_id", "y", ["0", "1"]).select("repeat", "y_true", "y_pred").withColumn("arm", F.lit("majority"))
    )
    return metrics.macro_metrics(metrics.confusion(both, ["arm", "repeat"], "y_true", "y_pred", ["0", "1"]), ["arm", "repeat"], ["0", "1"])


def _run_of_trees(spark, sf):
    """The reported run: 500 trees for each of three grouped folds, with its model and folds."""
    d = checkpointed(_labelled(spark, sf))
    folds = checkpointed(groups.grouped_folds(d, "doc_id", "group", "y", 3, seed=1))
    return d, folds, *extra_trees.out_of_fold_trees(d, folds, "doc_id", FEATURES, "y", ["0", "1"], pack=True)


def q_extra_trees(spark, sf):
    return _run_of_trees(spark, sf)[3]


def q_permutation_importance(spark, sf):
    d, folds, model, told = _run_of_trees(spark, sf)
    return importance.permutation_importance(model, checkpointed(told), d, folds, "doc_id", FEATURES, "y", ["0", "1"])


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

SQL = {
    "q_filesystem_features": """
WITH f AS (SELECT p_size AS firmware_id, p_partkey AS k, (p_size % 7 = 0 AND p_partkey % 11 = 0) AS unread FROM part WHERE p_partkey % 5 <> 0),
e AS (SELECT DISTINCT firmware_id, CASE k % 4 WHEN 0 THEN 'exec' WHEN 1 THEN 'lib' ELSE 'bad' END AS kind, CASE WHEN k % 4 <> 1 THEN k END AS content,
        CASE WHEN k % 4 = 0 AND k % 3 = 0 THEN 8 WHEN k % 4 < 2 THEN 40 END AS machine FROM f WHERE k % 4 < 3 AND NOT unread),
m AS (SELECT firmware_id, machine FROM e WHERE machine IS NOT NULL GROUP BY firmware_id, machine QUALIFY row_number() OVER (PARTITION BY firmware_id ORDER BY count(*) DESC, machine) = 1),
s AS (SELECT firmware_id, count(*) AS n, count(*) FILTER (kind = 'exec') AS x, count(*) FILTER (kind = 'lib') AS l, count(*) FILTER (kind = 'bad') AS b FROM e GROUP BY ALL),
c AS (SELECT firmware_id, count(*) AS n, min(CASE WHEN unread THEN 'squashfs-root/bin/f' || k END) AS err FROM f GROUP BY ALL)
SELECT firmware_id, CASE WHEN err IS NULL THEN 'ok' ELSE 'erro' END AS fs_status, err AS fs_error, CASE WHEN err IS NULL THEN c.n END AS unpacked_n_files,
  CASE WHEN err IS NULL THEN coalesce(s.n, 0) END AS unpacked_n_elf, CASE WHEN err IS NULL THEN coalesce(x, 0) END AS unpacked_n_elf_exec, CASE WHEN err IS NULL THEN coalesce(l, 0) END AS unpacked_n_elf_lib,
  CASE WHEN err IS NULL THEN coalesce(x + l, 0) END AS unpacked_n_elf_static, CASE WHEN err IS NULL THEN coalesce(b, 0) END AS fs_elf_malformed, CASE WHEN err IS NULL THEN machine::BIGINT END AS fs_arch,
  CASE WHEN err IS NULL AND x + l > 0 THEN 0.0::DOUBLE END AS prop_nx, CASE WHEN err IS NULL AND x > 0 THEN 0.0::DOUBLE END AS prop_pie
FROM c LEFT JOIN s USING (firmware_id) LEFT JOIN m USING (firmware_id)""",
    "q_model_of_file": " UNION ALL ".join(f"SELECT p_partkey, {n} AS name, {m} AS model FROM part" for _, n, m in FILES),
    "q_resolved_product": """
WITH a AS (SELECT p_partkey, p_size, (p_size % 3 = 0)::INT AS x, (p_size % 5 = 0)::INT AS y, (p_size % 2 = 0)::INT AS h FROM part)
SELECT p_partkey, x + y + h AS n_accepted,
  CASE WHEN x + y = 1 THEN 'cpe:2.3:o:acme:m' || p_size || CASE WHEN x = 1 THEN '_' ELSE '-' END || 'firmware:*:*:*:*:*:*:*:*'
       WHEN x + y = 0 AND h = 1 THEN 'cpe:2.3:h:acme:m' || p_size || ':*:*:*:*:*:*:*:*' END AS cpe_name FROM a""",
    "q_stream_counts": counts_sql(f"SELECT doc_id::VARCHAR AS key, unnest({RUNS}) AS s FROM documents", "SELECT doc_id::VARCHAR AS key FROM documents"),
}
