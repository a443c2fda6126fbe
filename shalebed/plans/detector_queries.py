"""Queries of the evidence detectors.

The raw tables hold few findings, so the scans also read composed strings: for
each order a fixed list of strings made from its key, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import printable_runs, strings_of
from ..operators import detectors as D
from ..sources.tables import table
from .text_queries import RUNS

#: Expressions of k that both engines read alike; {sha} is the SHA-256 of k as text.
COMPOSED = [
    "CASE k % 5 WHEN 0 THEN 'wpa_psk=' || k WHEN 1 THEN 'password=%s' WHEN 2 THEN 'password_length=8' WHEN 3 THEN 'default login admin' ELSE 'confirm password' END",
    "CASE k % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'root' ELSE 'alice' END || ':' || CASE k % 4 WHEN 0 THEN '1234' WHEN 1 THEN 'toor' WHEN 2 THEN 'zzz' ELSE 'pass' END",
    "'host ' || (k % 223 + 1) || '.' || (k % 256) || '.' || (7 * k % 256) || '.' || (13 * k % 256)",
    "CASE k % 4 WHEN 0 THEN 'version 8.8.8.' || (k % 256) WHEN 1 THEN 'gateway 10.0.0.' || (k % 300) WHEN 2 THEN 'dns 100.64.1.' || (k % 256) ELSE (k % 300) || '.1.2.3:80' END",
    "CASE k % 3 WHEN 0 THEN '/usr/sbin/telnetd' WHEN 1 THEN 'user guest' ELSE 'guest book' END",
    "'OpenSSL 1.' || (k % 3) || '.' || (k % 5)",
    "'BusyBox v1.' || (k % 40) || '.0'",
    "'Dropbear v2022.' || (k % 90)",
    "'x ' || translate(substring({sha}, 1, 32), '0123456789abcdef', 'Ab3dEf7hIjKl9NoP') || translate(substring({sha}, 33, 32), '0123456789abcdef', 'qRsTuVwXyZ1M5g0Q')",
    "'see https://a.example/x?ip=8.8.8.8&q=' || k || ' and http://b.example/' || k",
    "CASE WHEN k % 7 = 0 THEN 'id ' || {sha} ELSE 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ' END",
]


def composed(spark: SparkSession, sf: str) -> DataFrame:
    """(k, pos, s) of all orders."""
    parts = [F.expr(e.replace("{sha}", "sha2(CAST(k AS STRING), 256)")) for e in COMPOSED]
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return keys.select("k", F.posexplode(F.array(*parts)).alias("pos", "s"))


def _all_strings(spark: SparkSession, sf: str) -> DataFrame:
    """(key, pos, s) of documents, pages' addresses and composed strings."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), "text")
    pages = table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("key"), F.col("url").alias("text"))
    raw = strings_of(docs.unionByName(pages), "key", F.col("text"))
    return raw.unionByName(composed(spark, sf).select(F.concat(F.lit("o"), "k").alias("key"), "pos", "s"))


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("documents", "d", "doc_id"), ("pages", "p", "page_id"), ("orders", "o", "o_orderkey")]
    a, b, c = (table(spark, sf, t).select(F.concat(F.lit(x), k).alias("key")) for t, x, k in parts)
    return a.unionByName(b).unionByName(c)


def q_detector_counts(spark, sf):
    return D.scan_counts(_all_strings(spark, sf), _keys(spark, sf), "key")


def q_findings_reduced(spark, sf):
    """The same through rows of findings."""
    return D.reduce_findings(_keys(spark, sf), D.find(_all_strings(spark, sf), ["key"], fields=["detector"]), "key")


def _found(name: str):
    def query(spark, sf):
        detector = [d for d in D.DETECTORS if d.name == name]
        return D.find(composed(spark, sf), ["k", "pos"], detectors=detector).select(
            "k", F.col("pos").cast("long").alias("pos"), "type", "source", "context", "confidence", "detector_version"
        )

    return query


def q_ipv4_documents(spark, sf):
    """Addresses of document strings when each is given a network word."""
    s = table(spark, sf, "documents").select("doc_id", F.explode(printable_runs(F.col("text"))).alias("s"))
    found = s.select("doc_id", F.explode(D.contextual_addresses(F.concat(F.lit("host "), "s"))).alias("a"))
    return found.groupBy("doc_id").agg(F.count_if(D.is_public(F.col("a"))).alias("public"), F.count_if(~D.is_public(F.col("a"))).alias("non_public"))


def q_urls(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("s"))
    return D.find(pages, ["page_id"], detectors=[d for d in D.DETECTORS if d.name == "urls"])


#: Signature lines of each part, from its name and size.
LINES = [
    "(p_partkey % 9000) || '  0x' || p_size || '  ' || CASE p_size % 4 WHEN 0 THEN 'Squashfs filesystem' WHEN 1 THEN 'JFFS2 filesystem' WHEN 2 THEN 'LZMA compressed data' ELSE 'gzip compressed data' END",
    "(p_partkey % 7000) || '  0x1  ' || CASE p_size % 5 WHEN 0 THEN 'Squashfs filesystem, xz' WHEN 1 THEN 'AES S-Box' WHEN 2 THEN 'OpenSSL encryption, salted' WHEN 3 THEN 'Certificate in DER format' ELSE 'AES encrypted' END",
    "CASE WHEN p_size % 2 = 0 THEN 'DECIMAL  HEXADECIMAL  DESCRIPTION' ELSE '12  0xC  ubifs image' END",
]


def q_signature_lines(spark, sf):
    parts = table(spark, sf, "part")
    lines = parts.select("p_partkey", F.posexplode(F.array(*[F.expr(e) for e in LINES])).alias("pos", "line"))
    lines = lines.select("p_partkey", "pos", D.signature_text(F.col("line")).alias("description")).where(F.col("description").isNotNull())
    return D.structural_features(lines, "p_partkey")


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_KV = D.KEY_VALUE
_TOKENS = "string_split_regex(lower(regexp_replace(x[1], '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_-]')"
_COMPOSED_SQL = "SELECT k, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT o_orderkey AS k, [" + ", ".join(
    e.replace("{sha}", "sha256(k::VARCHAR)").replace("k %", "o_orderkey %").replace("|| k", "|| o_orderkey").replace("* k", "* o_orderkey").replace("sha256(k", "sha256(o_orderkey")
    for e in COMPOSED
) + "] AS l FROM orders)"
_WORDS = "regexp_extract_all(lower(s), '[a-z0-9]+')"
_PLAIN = _list([w for w in D.DEFAULT_PASSWORDS if w not in D.AUTH_WORDS])
_NUMBER = "(o[1]::BIGINT * 16777216 + o[2]::BIGINT * 65536 + o[3]::BIGINT * 256 + o[4]::BIGINT)"
_INSIDE = " OR ".join(f"{_NUMBER} BETWEEN {D.address_number(a)} AND {D.address_number(b)}" for a, b in D.NOT_GLOBAL)
_URL_SQL = "(?i)https?://[^\\s\"''<>]+"
_BARE = f"regexp_replace(regexp_replace(s, '{_URL_SQL}', 'U', 'g'), '(?i)(\\bv|\\bversion)\\s*\\d{{1,3}}(\\.\\d{{1,3}}){{3}}', 'X', 'g')"
_ADDRESSES = f"""list_filter(list_transform(list_filter(string_split_regex({_BARE}, '[^-_A-Za-z0-9.]+'), lambda x: regexp_matches(x, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}($|\\.$|\\.\\.)')),
  lambda x: string_split(regexp_extract(x, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}'), '.')),
  lambda o: len(list_filter(o, lambda y: y::INT > 255)) = 0 AND o[1]::INT NOT IN (0, 127, 255)
    AND (list_has_any({_WORDS}, {_list(D.NETWORK_WORDS)}) OR regexp_matches(lower(s), 'https?://') OR regexp_matches(s, '\\d:\\d')))"""
_PASSWORD = f"""len(list_filter(list_zip(regexp_extract_all(s, '{_KV}', 1), regexp_extract_all(s, '{_KV}', 2)), lambda x:
  list_has_any({_TOKENS}, {_list(D.CREDENTIAL_WORDS)}) AND NOT list_has_any({_TOKENS}, {_list(D.METADATA_WORDS)})
  AND NOT (starts_with(x[2], '%') OR regexp_matches(x[2], '^\\$\\{{?\\w+\\}}?$') OR regexp_matches(x[2], '^\\{{\\{{?\\w+\\}}?\\}}$|^<\\w+>$')
           OR lower(trim(x[2], '()')) IN ('null', 'none', 'nil', 'undefined', '(null)')))) > 0"""
_WEAK = f"(list_has_any({_WORDS}, {_PLAIN}) AND list_has_any({_WORDS}, {_list(D.AUTH_WORDS)}))"


def _old(library: str) -> str:
    pattern, least = D.LIBRARIES[library]
    parts = f"list_transform(list_filter(string_split_regex(regexp_extract(s, '{pattern}', 1), '[.\\-_]'), lambda y: regexp_matches(y, '^\\d')), lambda y: regexp_extract(y, '^\\d+')::BIGINT)"
    return f"(regexp_matches(s, '{pattern}') AND {parts} < {list(least)}::BIGINT[])"


_RUN = "len(list_filter(range(1, length(t) - 3), lambda i: ascii(t[i + 1]) = ascii(t[i]) + 1 AND ascii(t[i + 2]) = ascii(t[i]) + 2 AND ascii(t[i + 3]) = ascii(t[i]) + 3 AND ascii(t[i + 4]) = ascii(t[i]) + 4)) > 0"
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: -((length(t) - length(replace(t, c, ''))) / length(t)) * log2((length(t) - length(replace(t, c, ''))) / length(t))))"
_API = f"""list_filter(list_filter(string_split_regex(s, '[^A-Za-z0-9+/=]+'), lambda t: regexp_matches(t, '^([0-9a-fA-F]{{32,}}|[A-Za-z0-9+/]{{40,}}={{0,2}})$')),
  lambda t: NOT ({_RUN}) AND (regexp_matches(t, '^[0-9a-fA-F]{{32,}}$') OR (regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]') AND {_ENTROPY} >= 4.3)))"""
_PAIRS = f"""len(list_filter(list_zip(regexp_extract_all(s, '{D.PAIR}', 1), regexp_extract_all(s, '{D.PAIR}', 2)), lambda x:
  list_contains({_list(D.WEAK_WORDS)}, lower(x[1])) AND list_contains({_list(D.WEAK_WORDS)}, lower(x[2])))) > 0"""
_DEBUG = f"(list_has_any({_WORDS}, ['debug', 'guest', 'test']) AND list_has_any({_WORDS}, {_list(D.AUTH_WORDS)}))"

def counts_sql(strings: str, keys: str) -> str:
    return f"""
WITH s AS ({strings}),
k AS ({keys}),
f AS (SELECT key, s, {_ADDRESSES} AS ips FROM s),
c AS (SELECT key,
  count(*) FILTER ({_PASSWORD} OR {_WEAK}) AS count_hardcoded_passwords,
  count(*) FILTER ({_PAIRS}) AS count_credential_pairs,
  sum(len(list_filter(ips, lambda o: {_INSIDE})))::BIGINT AS count_non_public_ips,
  sum(len(list_filter(ips, lambda o: NOT ({_INSIDE}))))::BIGINT AS count_public_ips,
  bool_or(contains(s, 'telnetd')) AS has_telnetd,
  bool_or({_DEBUG}) AS has_debug_account,
  bool_or({_old("libssl")}) AS has_outdated_libssl,
  bool_or({_old("busybox")}) AS has_outdated_busybox,
  bool_or({_old("dropbear")}) AS has_outdated_dropbear,
  sum(len(regexp_extract_all(s, '{_URL_SQL}')))::BIGINT AS count_urls,
  sum(len({_API}))::BIGINT AS count_api_tokens
  FROM f GROUP BY key)
SELECT k.key, {", ".join(f"coalesce(c.{d.column}, {0 if d.reduces == 'count' else 'false'}) AS {d.column}" for d in D.SCANNED)}
FROM k LEFT JOIN c USING (key)"""


_COUNTS_SQL = counts_sql(
    f"""SELECT 'd' || doc_id AS key, unnest({RUNS}) AS s FROM documents
  UNION ALL SELECT 'p' || page_id, unnest(list_transform(regexp_extract_all(url, '[\\x20-\\x7e]{{4,}}'), lambda x: x[1:1024])) FROM pages
  UNION ALL SELECT 'o' || k, s FROM ({_COMPOSED_SQL})""",
    "SELECT 'd' || doc_id AS key FROM documents UNION SELECT 'p' || page_id FROM pages UNION SELECT 'o' || o_orderkey FROM orders",
)


def _found_sql(kind: str, version: str, where: str, context: str, confidence: str, explode: str = "") -> str:
    return f"""SELECT k, pos, '{kind}' AS type, s AS source, {context} AS context, {confidence} AS confidence, '{version}' AS detector_version
FROM (SELECT *{explode} FROM ({_COMPOSED_SQL})) WHERE {where}"""


def _library_sql(library: str) -> str:
    pattern, least = D.LIBRARIES[library]
    shown = "(" + ", ".join(map(str, least)) + ")"
    version = {"libssl": "1.0", "busybox": "1.0", "dropbear": "2.0"}[library]
    return _found_sql("outdated_library", version, _old(library), f"'{library} version ' || regexp_extract(s, '{pattern}', 1) || ' below threshold {shown}'", "'medium'")


_IP = lambda which, name, conf: _found_sql(
    f"{which}_ip", "2.0", "true", f"'{name} IPv4 address: ' || array_to_string(list_transform(a, lambda y: (y::INT)::VARCHAR), '.')", f"'{conf}'",
    f", unnest(list_filter({_ADDRESSES}, lambda o: {'NOT' if which == 'public' else ''} ({_INSIDE}))) AS a",
)

QUERIES = {
    "q_detector_counts": q_detector_counts,
    "q_findings_reduced": q_findings_reduced,
    "q_passwords": _found("hardcoded_passwords"),
    "q_credential_pairs": _found("credential_pairs"),
    "q_ipv4_non_public": _found("non_public_ips"),
    "q_ipv4_public": _found("public_ips"),
    "q_telnetd": _found("telnetd"),
    "q_debug_account": _found("debug_account"),
    "q_outdated_libssl": _found("outdated_libssl"),
    "q_outdated_busybox": _found("outdated_busybox"),
    "q_outdated_dropbear": _found("outdated_dropbear"),
    "q_api_tokens": _found("api_tokens"),
    "q_composed_urls": _found("urls"),
    "q_ipv4_documents": q_ipv4_documents,
    "q_urls": q_urls,
    "q_signature_lines": q_signature_lines,
}

SQL = {
    "q_detector_counts": _COUNTS_SQL,
    "q_findings_reduced": _COUNTS_SQL,
    "q_passwords": _found_sql(
        "credential_candidate", "2.0", f"{_PASSWORD} OR {_WEAK}",
        f"CASE WHEN {_PASSWORD} THEN 'key=value assignment: ''' || regexp_extract(s, '{_KV}', 0) || '''' ELSE 'default password token: ''' || list_filter(regexp_extract_all(s, '[A-Za-z0-9]+'), lambda w: list_contains({_PLAIN}, lower(w)))[1] || '''' END",
        f"CASE WHEN {_PASSWORD} THEN 'high' ELSE 'medium' END",
    ),
    "q_credential_pairs": _found_sql("credential_pair", "1.0", _PAIRS, f"'weak user:pass pair: ''' || regexp_extract(s, '{D.PAIR}', 0) || ''''", "'high'"),
    "q_ipv4_non_public": _IP("non_public", "non-public", "low"),
    "q_ipv4_public": _IP("public", "public (global)", "high"),
    "q_telnetd": _found_sql("exposed_service", "1.0", "contains(s, 'telnetd')", "'''telnetd'' substring found'", "'high'"),
    "q_debug_account": _found_sql("debug_account", "2.0", _DEBUG, f"'debug/guest/test keyword: ''' || list_filter({_WORDS}, lambda w: w IN ('debug', 'guest', 'test'))[1] || ''''", "'low'"),
    "q_outdated_libssl": _library_sql("libssl"),
    "q_outdated_busybox": _library_sql("busybox"),
    "q_outdated_dropbear": _library_sql("dropbear"),
    "q_api_tokens": _found_sql("api_token_candidate", "2.0", "true", "'long token: ' || left(t, 12) || '…'", "'low'", f", unnest({_API}) AS t"),
    "q_composed_urls": _found_sql("url", "1.0", "true", "'URL: ' || u", "'low'", f", unnest(regexp_extract_all(s, '{_URL_SQL}')) AS u"),
    "q_ipv4_documents": f"""
WITH s AS (SELECT doc_id, 'host ' || unnest({RUNS}) AS s FROM documents),
a AS (SELECT doc_id, unnest({_ADDRESSES}) AS o FROM s)
SELECT doc_id, count(*) FILTER (NOT ({_INSIDE})) AS public, count(*) FILTER ({_INSIDE}) AS non_public FROM a GROUP BY doc_id""",
    "q_urls": f"""SELECT page_id, 'url' AS type, url AS source, 'URL: ' || u AS context, 'low' AS confidence, 'urls' AS detector, '1.0' AS detector_version
FROM (SELECT *, unnest(regexp_extract_all(url, '{_URL_SQL}')) AS u FROM pages)""",
    "q_signature_lines": f"""
WITH l AS (SELECT p_partkey, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT p_partkey, [{", ".join(LINES)}] AS x FROM part)),
d AS (SELECT p_partkey, pos, regexp_extract(line, '^\\s*(\\d+)\\s+\\S+\\s+(.*)$', 2) AS d FROM l WHERE regexp_matches(line, '^\\s*\\d+\\s+\\S+\\s+.*$')),
m AS (SELECT p_partkey, pos, d, lower(regexp_extract(d, '{D.FILESYSTEM}')) AS fs, lower(regexp_extract(d, '{D.COMPRESSION}')) AS packed FROM d),
k AS (SELECT p_partkey, fs, count(*) AS n, min(pos) AS seen FROM m WHERE fs <> '' GROUP BY ALL),
f AS (SELECT p_partkey, arg_max(fs, n * 100 - seen) AS fs_type FROM k GROUP BY ALL)
SELECT p_partkey, count(*) FILTER (fs <> '') AS n_filesystems, arg_min(packed, pos) FILTER (packed <> '') AS compression_type,
       count(*) FILTER (regexp_matches(d, '{D.CRYPTO}')) AS n_crypto_signatures,
       bool_or(regexp_matches(d, '{D.ENCRYPTED}') AND NOT contains(lower(d), 's-box')) AS has_encrypted_sections, any_value(fs_type) AS fs_type
FROM m LEFT JOIN f USING (p_partkey) GROUP BY p_partkey""",
}
