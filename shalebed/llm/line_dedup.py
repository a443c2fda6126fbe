"""Line dedup: lines that many documents share are kept in one document only.

Native plan: normalised lines are exploded and hashed, distinct documents are
counted per hash, and the positions to drop go back to their document, where
the remaining lines are joined again in order. Text crosses the network once
(the last join); everything before moves two 64-bit hashes and an id per line.
A line held by a third of all documents is harmless: its occurrences are first
made distinct by (hash, document), then counted with map-side sums, and the
join with the few shared hashes is left to adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, ascii_lower, strip_white, table, wide_hash


def _hashed(lines: DataFrame, min_chars: int) -> DataFrame:
    """Adds h1 and h2; keeps the lines whose key is long enough."""
    keyed = lines.withColumn("key", ascii_lower(strip_white(F.col("line")))).where(F.length("key") >= min_chars)
    return keyed.select("*", *wide_hash(F.col("key"))).drop("key", "line")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of docs, text without the lines it loses, n_lines and n_dropped.

    A line's key is the line stripped of white space with A-Z lower-cased. Keys
    of at least min_chars code points found in at least min_docs documents stay
    only in the largest doc_id that holds them.

    A null or empty text is one empty line. Rows without doc_id count as one
    document that precedes all others; rows that repeat a doc_id count once and
    each keeps its own row. Extra columns pass through, but for n_lines and
    n_dropped, which are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    text = F.coalesce("text", F.lit(""))
    key = [F.coalesce("doc_id", F.lit(NO_ID)).alias("__doc"), F.xxhash64(text).alias("__text")]
    lines = F.split(text, "\n", -1)

    held = _hashed(docs.select(key[0], F.explode(lines).alias("line")), min_chars).distinct()
    shared = (
        held.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("__doc").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .drop("n")
    )
    drops = (
        _hashed(docs.select(*key, F.posexplode(lines).alias("pos", "line")), min_chars)
        .join(shared, ["h1", "h2"])
        .where(F.col("__doc") != F.col("keeper"))
        .groupBy("__doc", "__text")
        .agg(F.collect_set("pos").alias("__drop"))
    )
    joined = docs.select("*", *key).join(drops, ["__doc", "__text"], "left").withColumn("__lines", F.split(text, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    rest = F.when(F.col("__drop").isNull(), text).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    )
    return joined.select(
        *[rest.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, t.pos AS pos, t.line AS line,
         translate(trim(t.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS pos) t),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND s.keeper <> l.doc_id AS dropped
  FROM lines l LEFT JOIN shared s ON s.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
