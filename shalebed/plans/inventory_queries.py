"""Queries of file system roots: every part is an entry of the image of its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import roots
from ..sources.tables import table

#: Expressions of k that both engines read alike.
PATH = """CASE k % 8
  WHEN 0 THEN 'out/squashfs-root/bin/f' || k
  WHEN 1 THEN 'out/squashfs-root/sub/cpio-root/x' || k
  WHEN 2 THEN 'ext-root-' || (k % 3) || '/etc/f' || k
  WHEN 3 THEN 'carved/f' || k
  WHEN 4 THEN 'out/squashfs-root/lnk' || (k % 5) || '/deep/f' || k
  WHEN 5 THEN CASE k % 3 WHEN 0 THEN 'jffs2-root' ELSE 'out/squashfs-root/lnk' || (k % 5) END
  WHEN 6 THEN 'jffs2-root/lib/l' || (k % 7)
  ELSE 'empty-root-' || (k % 4) END"""
KIND = "CASE k % 8 WHEN 5 THEN 'link' WHEN 7 THEN CASE k % 5 WHEN 0 THEN 'link' ELSE 'dir' END ELSE 'file' END"


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("firmware_id"), F.col("p_partkey").alias("k"))
    return parts.select("firmware_id", F.expr(PATH).alias("path"), F.expr(KIND).alias("kind"))


def q_file_roots(spark, sf):
    """The roots of each image, nested ones not repeated, links not followed."""
    return roots.find_roots(_inventory(spark, sf))


def q_root_files(spark, sf):
    """The files below each root."""
    return roots.root_files(_inventory(spark, sf))


_ENTRIES = f"""WITH e AS (
  SELECT DISTINCT firmware_id, {PATH} AS path, {KIND} AS kind FROM (SELECT p_size::BIGINT AS firmware_id, p_partkey AS k FROM part)
), r AS (
  SELECT firmware_id, path, kind,
    regexp_extract(CASE kind WHEN 'dir' THEN path || '/' ELSE path END, '^((?:.*?/)??[a-z0-9]+-root(?:-[0-9]+)?)/', 1) AS root
  FROM e WHERE kind <> 'link' AND NOT EXISTS (
    SELECT 1 FROM e AS l WHERE l.kind = 'link' AND l.firmware_id = e.firmware_id AND starts_with(e.path, l.path || '/'))
)"""

QUERIES = {"q_file_roots": q_file_roots, "q_root_files": q_root_files}

SQL = {
    "q_file_roots": f"""{_ENTRIES}
SELECT firmware_id, root, count(*) FILTER (kind = 'file') AS n_files,
  min(substring(path, length(root) + 2)) FILTER (kind = 'file') AS first_path, max(substring(path, length(root) + 2)) FILTER (kind = 'file') AS last_path
FROM r WHERE root <> '' GROUP BY firmware_id, root""",
    "q_root_files": f"""{_ENTRIES}
SELECT firmware_id, root, substring(path, length(root) + 2) AS path FROM r WHERE root <> '' AND kind = 'file'""",
}
