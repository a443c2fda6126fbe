"""Queries over strings and bytes of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.byte_stats import byte_features
from ..sources.tables import table

RUNS = "list_transform(regexp_extract_all(text, '[\\x20-\\x7e]{4,}'), lambda x: x[1:1024])"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _content(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("content"))


def q_strings(spark, sf):
    s = S.strings_of(_docs(spark, sf), "doc_id", F.col("text"))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), "s")


def q_document_build(spark, sf):
    s = S.strings_of(_docs(spark, sf), "doc_id", F.col("text"))
    return S.build_documents(s, "doc_id", max_strings=2000, max_chars=200_000)


def q_tokens(spark, sf):
    runs = S.limited_strings(S.printable_runs(F.col("text")), 2000)
    docs = _docs(spark, sf).select("doc_id", S.joined_document(runs, 200_000).alias("document"))
    tokens = docs.select("doc_id", F.posexplode(S.tokens_of(F.col("document"))).alias("pos", "token"))
    return tokens.select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


def q_byte_histogram(spark, sf):
    return S.byte_histogram(_content(spark, sf), "doc_id", F.col("content")).withColumn("byte", F.col("byte").cast("long"))


def _measured(spark, sf, **options):
    return _content(spark, sf).select("doc_id", byte_features(F.col("content"), **options).alias("b")).select("doc_id", "b.*")


def q_entropy(spark, sf):
    return _measured(spark, sf).select("doc_id", F.round("entropy", 6).alias("entropy"), F.round("byte_mean", 6).alias("byte_mean"))


def q_section_entropy_variance(spark, sf):
    d = _measured(spark, sf, section=512)
    return d.select("doc_id", "n_sections", F.round("entropy_variance", 6).alias("entropy_variance"))


def q_compress_ratio(spark, sf):
    return _measured(spark, sf).select("doc_id", "compress_ratio")


def q_content_key(spark, sf):
    return _content(spark, sf).select("doc_id", S.content_key(F.col("content")).alias("content_key"), F.octet_length("content").cast("long").alias("n_bytes"))


_HISTOGRAM = """bytes AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents),
hist AS (SELECT doc_id, ('0x' || h)::INT::BIGINT AS byte, count(*) AS n FROM bytes GROUP BY doc_id, h)"""

QUERIES = {
    "q_strings": q_strings,
    "q_document_build": q_document_build,
    "q_tokens": q_tokens,
    "q_byte_histogram": q_byte_histogram,
    "q_entropy": q_entropy,
    "q_section_entropy_variance": q_section_entropy_variance,
    "q_compress_ratio": q_compress_ratio,
    "q_content_key": q_content_key,
}

SQL = {
    "q_strings": f"SELECT doc_id, unnest(r) AS s, generate_subscripts(r, 1) - 1 AS pos FROM (SELECT doc_id, {RUNS} AS r FROM documents)",
    "q_document_build": f"""
WITH s AS (SELECT doc_id, unnest(r) AS s, generate_subscripts(r, 1) AS pos FROM (SELECT doc_id, {RUNS} AS r FROM documents)),
f AS (SELECT doc_id, s, min(pos) AS pos FROM s GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS nth, sum(length(s) + 1) OVER w - length(s) - 1 AS before FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, coalesce(string_agg(left(s, (200000 - before)::INT), chr(10) ORDER BY pos) FILTER (nth <= 2000 AND before < 200000), '') AS document,
       count(*) FILTER (nth <= 2000 AND before < 200000) AS n_strings,
       bool_or(NOT (nth <= 2000 AND before < 200000) OR before + length(s) > 200000) AS truncated
FROM o GROUP BY doc_id""",
    "q_tokens": f"""
WITH d AS (SELECT doc_id, left(array_to_string(({RUNS})[1:2000], chr(10)), 200000) AS document FROM documents),
t AS (SELECT doc_id, list_filter(string_split_regex(document, '\\s+'), lambda x: x <> '') AS l FROM d)
SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM t""",
    "q_byte_histogram": f"WITH {_HISTOGRAM} SELECT doc_id, byte, n FROM hist",
    "q_entropy": f"""
WITH {_HISTOGRAM}, p AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM hist),
m AS (SELECT doc_id, -sum(p * log2(p)) AS entropy, sum(byte * n) / sum(n) AS byte_mean FROM p GROUP BY doc_id)
SELECT doc_id, round(coalesce(entropy, 0), 6) AS entropy, round(coalesce(byte_mean, 0), 6) AS byte_mean FROM documents LEFT JOIN m USING (doc_id)""",
    "q_section_entropy_variance": """
WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
s AS (SELECT doc_id, k AS section, substring(h, (k * 1024 + 1)::INT, 1024) AS part FROM b, LATERAL (SELECT unnest(range(0, length(h) // 1024)) AS k)),
x AS (SELECT doc_id, section, unnest(regexp_extract_all(part, '..')) AS h FROM s),
n AS (SELECT doc_id, section, h, count(*) AS n FROM x GROUP BY ALL),
e AS (SELECT doc_id, section, -sum(n / 512 * log2(n / 512)) AS entropy FROM n GROUP BY ALL),
v AS (SELECT doc_id, count(*) AS n_sections, var_pop(entropy) AS v FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_sections, 0) AS n_sections, round(CASE WHEN n_sections >= 2 THEN v ELSE 0 END, 6) AS entropy_variance
FROM documents LEFT JOIN v USING (doc_id)""",
    "q_content_key": "SELECT doc_id, sha256(text) AS content_key, octet_length(encode(text)) AS n_bytes FROM documents",
}
