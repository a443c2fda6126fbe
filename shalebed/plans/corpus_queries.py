"""Queries of versions, logic, labels, corpus building and description."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import contract as c
from ..functions import logic, versions
from ..operators import applicability, corpus, describe, labels, sampling
from ..sources.tables import table


def _rounded(df, *columns):
    return df.withColumns({x: F.round(x, 6) for x in columns})


# Versions ------------------------------------------------------------------


def q_version_compare(spark, sf):
    """Version text of each line item against bounds from its quantity and part."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws(".", F.pmod("l_partkey", F.lit(7)), "l_linenumber", F.lit("0")).alias("v"),
        F.concat_ws(".", F.pmod("l_suppkey", F.lit(7)), F.lit("3")).alias("b"),
    )
    v, b = versions.parse_version(F.concat("v", F.lit("(X)"))), versions.parse_version(F.col("b"))
    return li.select(
        "l_orderkey", "l_linenumber", versions.versions_equal(v, b).alias("same"),
        versions.version_in_range(v, start_including=b).alias("from_b"), versions.version_in_range(v, end_excluding=b).alias("before_b"),
    )


FILES = [
    ("netgear", "'R6250-V1.0.' || p_size || '.80_1.0.75.chk'"),
    ("netgear", "'WNDR_1_0_' || p_size || '_NA.img'"),
    ("asus", "'RT-AC66U_B1_3.0.0.4_384_' || (10000 + p_size) || '-gc9a116a.trx'"),
    ("belkin", "'F9K_v1.0.' || p_size || '.bin'"),
    ("dlink", "'FW1.' || p_size || '_V1.14.bin'"),
    ("tp_link", "'TL_3_' || p_size || '_2_up_boot.bin'"),
    ("other", "'x_1.2.' || p_size || '.bin'"),
]


def q_version_infer(spark, sf):
    parts = table(spark, sf, "part")
    rows = F.array(*[F.struct(F.lit(b).alias("brand"), F.expr(n).alias("name")) for b, n in FILES])
    named = parts.select("p_partkey", F.inline(rows))
    return named.select("p_partkey", "name", versions.infer_version(F.col("brand"), F.col("name")).alias("version"))


def q_model_keys(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", versions.model_key(F.col("p_brand"), F.col("p_name")).alias("model_key"), versions.canonical_product(F.concat("p_type", F.lit(" Firmware"))).alias("product"))


def q_search_variants(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("dir"), "p_size").alias("model"))
    return p.select("p_partkey", F.explode(versions.search_variants(F.col("model"), F.lit("d-link"), F.lit("dlink"))).alias("variant"))


# Logic ---------------------------------------------------------------------


def q_kleene(spark, sf):
    """All and any of an order's lines, each known only where its quantity isn't 25."""
    li = table(spark, sf, "lineitem")
    known = F.when(F.col("l_quantity") != 25, F.col("l_quantity") > 25)
    lists = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(known.alias("v"))).alias("v"))
    values = F.transform("v", lambda x: x["v"])
    return lists.select("l_orderkey", logic.all_of(values).alias("all_of"), logic.any_of(values).alias("any_of"))


_CRITERIA = "cpe:2.3:o:acme:router_firmware:*:*:*:*:*:*:*:*"


def q_applicability(spark, sf):
    """A tree for each line item: a range on the product, alone, with its own hardware,
    or as the last of a chain of five levels of nodes.
    """
    hardware = "cpe:2.3:h:acme:router:-:*:*:*:*:*:*:*"
    other = json.dumps([{"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": _CRITERIA.replace("router", "camera")}]}]}])
    both = '[{"nodes":[{"operator":"AND","cpeMatch":[{"vulnerable":true,"criteria":"%s","versionEndExcluding":"'
    link = '{"operator":"AND","cpeMatch":[{"vulnerable":true,"criteria":"%s"}],"children":[' % _CRITERIA
    cves = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("entry"),
        F.col("l_linenumber").alias("cve_id"),
        F.concat_ws(".", F.pmod("l_partkey", F.lit(9)), F.pmod("l_suppkey", F.lit(5))).alias("version"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit("[]"))
        .when(F.col("l_linenumber") % 4 == 1, F.lit(other))
        .when(F.col("l_linenumber") == 7, F.concat(F.lit(f'[{{"nodes":[{link * 5}' + (both % _CRITERIA).partition('"nodes":[')[2]), F.col("l_quantity").cast("int") % 9, F.lit('.2"}]}' + "]}" * 5 + "]}]")))
        .otherwise(
            F.concat(
                F.lit(both % _CRITERIA), F.col("l_quantity").cast("int") % 9, F.lit('.2"},{"vulnerable":false,"criteria":"'),
                F.when(F.col("l_linenumber") % 4 == 2, F.lit(hardware)).otherwise(F.lit(hardware.replace("router", "camera"))), F.lit('"}]}]}]'),
            )
        )
        .alias("configurations"),
    )
    target = applicability.target_of(F.lit(None).cast("string"), F.lit("Acme"), F.lit("Router firmware"))
    return applicability.judge(cves.withColumn("target", target)).select("entry", "cve_id", "verdict", "only_others")


# Labels --------------------------------------------------------------------


def _judged(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("fw"), F.col("l_partkey").cast("string").alias("cve_id"), (F.col("l_quantity") / 5).alias("score"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(True)).when(F.col("l_linenumber") % 3 == 1, F.lit(None)).otherwise(F.lit(False)).alias("verdict"),
        F.struct("l_linenumber", "l_suppkey").alias("nth"),
    )


def _fws(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("fw"), (F.col("o_orderkey") % 11 == 0).alias("not_found"))


def q_bounds_label(spark, sf):
    return labels.bounded_labels(_fws(spark, sf), _judged(spark, sf), "fw")


def q_severity(spark, sf):
    scores = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") / 5).alias("score"),
        F.when(F.col("l_linenumber") == 1, "critical").when(F.col("l_linenumber") == 2, "High").when(F.col("l_linenumber") == 3, "").otherwise(F.lower("l_returnflag")).alias("severity"),
    )
    stats = labels.score_stats(scores, "o_orderkey", table(spark, sf, "orders"))
    return stats.withColumn("label", labels.label_of(F.col("cve_total"), F.col("cvss_max")))


def _aliases(spark, sf):
    """Documents as aliases of their text: content key, path, vendor, model."""
    return table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("firmware_id"), F.concat_ws("/", "lang", "source", "doc_id").alias("meta_path"), F.col("source").alias("vendor"),
        F.col("lang").alias("model"), F.length("text").cast("long").alias("n_chars"), "doc_id",
    )


def q_labelled_aliases(spark, sf):
    a = _aliases(spark, sf)
    judged = a.select(F.col("firmware_id").alias("fw"), F.col("vendor").alias("cve_id"), (F.col("n_chars") % 10).cast("double").alias("score"), (F.col("doc_id") % 3 != 0).alias("verdict"), F.col("doc_id").alias("nth"))
    found = labels.bounded_labels(a.select(F.col("firmware_id").alias("fw"), (F.col("doc_id") % 5 == 0).alias("not_found")), judged, "fw")
    told = labels.label_aliases(a.select(F.col("firmware_id").alias("fw"), "meta_path", F.when(F.col("doc_id") % 2 == 0, F.col("vendor")).alias("version")), found, "fw")
    return told.select("meta_path", "security_level", "cve_total", "alias_count", "versions_differ", "label_strategy", "evidence_reason")


# Corpus --------------------------------------------------------------------


def q_semi_anti(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    some = customers.join(orders, "c_custkey", "left_semi").select("c_custkey", F.lit("some").alias("orders"))
    return some.unionByName(customers.join(orders, "c_custkey", "left_anti").select("c_custkey", F.lit("none").alias("orders")))


def q_checked_join(spark, sf):
    joined = corpus.checked_join(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")
    return corpus.lookup_join(joined, table(spark, sf, "documents").select("lang").distinct().withColumn("known", F.lit(True)), "lang")


def q_full_reconcile(spark, sf):
    return corpus.unmatched(table(spark, sf, "documents"), table(spark, sf, "labels").where("doc_id % 2 = 0"), "doc_id")


def q_alias_collapse(spark, sf):
    return corpus.collapse_aliases(_aliases(spark, sf), "firmware_id", ["n_chars"], "doc_id").select("firmware_id", "meta_path", "n_chars")


def q_diverging_aliases(spark, sf):
    d = corpus.diverging_aliases(_aliases(spark, sf), "firmware_id", ["n_chars", "model", "vendor"])
    return d.select("firmware_id", F.array_join("columns", ",").alias("columns"))


def q_provenance(spark, sf):
    a = _aliases(spark, sf)
    p = corpus.provenance(a, "firmware_id", ["meta_path", "vendor", "model"], a.where("doc_id % 2 = 0"))
    text = F.array_join(F.transform("aliases", lambda x: F.concat_ws("|", x["meta_path"], x["vendor"], x["model"])), ";")
    return p.select("firmware_id", "in_table", text.alias("aliases"))


def _features(spark, sf):
    return _aliases(spark, sf).select(
        "firmware_id", "meta_path", "vendor", "doc_id",
        F.when(F.col("doc_id") % 13 == 0, "erro").when(F.col("doc_id") % 29 == 0, "timeout").otherwise("ok").alias("meta_binwalk_status"),
        F.when(F.col("doc_id") % 17 == 0, "falha").when(F.col("doc_id") % 31 == 0, F.lit(None)).otherwise("ok").alias("meta_unpack_status"),
        F.when(F.col("doc_id") % 37 == 0, "odd").otherwise("ok").alias("meta_fs_status"),
        F.when(F.col("doc_id") % 19 == 0, "DD-WRT").alias("meta_third_party"),
    )


def _undecided(spark, sf):
    return _aliases(spark, sf).select("firmware_id", F.when(F.col("n_chars") % 7 == 0, c.UNDECIDED).otherwise(c.KNOWN).alias("security_level")).distinct()


def q_state_violations(spark, sf):
    return corpus.state_violations(_features(spark, sf))


def q_exclusions(spark, sf):
    f = _features(spark, sf)
    reasons = corpus.exclusion_reasons(f, _undecided(spark, sf))
    return corpus.exclusion_report(reasons, corpus.vendors_by_id(f, "firmware_id", "vendor"), "firmware_id")


def q_undecided_share(spark, sf):
    return corpus.undecided_share(_features(spark, sf), _undecided(spark, sf), "firmware_id", "vendor")


def q_one_hot(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("")).when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"), "source")
    return corpus.one_hot(d, "lang", ["en", "fr"])


def q_multi_hot(spark, sf):
    return corpus.multi_hot(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


def q_constant_columns(spark, sf):
    d = table(spark, sf, "documents").select(F.lit(1).alias("one"), F.lit(None).cast("int").alias("none"), "lang", F.when(F.col("lang") == "en", 1).alias("some"))
    return corpus.constant_columns(d, d.columns)


def q_support(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return corpus.support(joined, "source", "quality")


def q_group_support(spark, sf):
    return corpus.group_support(table(spark, sf, "documents"), "source", "lang", ["en", "fr", "de"])


def q_multiset_signature(spark, sf):
    """Whether the orders of two halves of a customer's keys have equal multisets of priorities."""
    o = table(spark, sf, "orders").select(F.pmod("o_custkey", F.lit(50)).alias("k"), (F.col("o_custkey") % 100 < 50).alias("half"), "o_orderstatus")
    s = corpus.multiset_signature(o, ["k", "half"], ["o_orderstatus"])
    return s.groupBy("k").agg(F.sum("n").alias("n"), (F.count_distinct("signature") == 1).alias("same"))


def q_finding_key(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return d.select("doc_id", corpus.finding_key("lang", "source").alias("finding_key"))


def q_set_ops(spark, sf):
    cu = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n"))
    su = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n"))
    kinds = [("union", cu.union(su).distinct()), ("both", cu.intersect(su)), ("customers_only", cu.subtract(su)), ("all", cu.unionByName(su))]
    out = None
    for name, df in kinds:
        one = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("kind", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def q_difference(spark, sf):
    a = table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    return sampling.difference(a.where("o_orderkey % 3 = 0"), a.where("o_orderkey % 5 = 0")).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total"))


# Description ---------------------------------------------------------------


def q_prevalence(spark, sf):
    d = table(spark, sf, "documents").select(
        "lang", (F.col("doc_id") % 3 == 0).alias("a"), F.when(F.col("source") != "src1", F.col("n_chars") % 2).alias("b"), F.when(F.col("lang") == "en", F.lit(True)).alias("c")
    )
    return _rounded(describe.prevalence(d.withColumns({"a": F.col("a").cast("int"), "c": F.col("c").cast("int")}), "lang", ["a", "b", "c"]), "ratio")


def q_coverage(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("quantity"), F.col("l_extendedprice").alias("price"))
    return _rounded(describe.coverage(li, ["l_returnflag"], "l_linestatus", ["quantity", "price"]), "q1", "median", "q3", "mean")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

_V = "[(l_partkey % 7)::BIGINT, l_linenumber::BIGINT]"
_B = "[(l_suppkey % 7)::BIGINT, 3::BIGINT]"
_ALIASES = "SELECT sha256(text) AS firmware_id, lang || '/' || source || '/' || doc_id AS meta_path, source AS vendor, lang AS model, length(text) AS n_chars, doc_id FROM documents"
_LABEL = lambda n, m: f"CASE WHEN {n} = 0 THEN 'sem_cve_conhecida' WHEN {m} >= 9 THEN 'cve_critica' ELSE 'cve_conhecida' END"
_BOUNDED = f"""
e AS (SELECT fw, cve_id, bool_or(coalesce(verdict, false)) AS ok, arg_max(score, nth) AS score FROM judged WHERE verdict IS NULL OR verdict GROUP BY ALL),
s AS (SELECT fw, count(*) FILTER (ok) AS ln, max(score) FILTER (ok) AS lm, count(*) AS hn, max(score) AS hm FROM e GROUP BY fw),
k AS (SELECT fw, bool_or(not_found) AS nf FROM keys GROUP BY fw),
j AS (SELECT k.fw, nf, coalesce(ln, 0) AS ln, coalesce(lm, 0) AS lm, coalesce(hn, 0) AS hn, coalesce(hm, 0) AS hm FROM k LEFT JOIN s USING (fw)),
b AS (SELECT *, {_LABEL("ln", "lm")} AS low, CASE WHEN nf THEN 'cve_critica' ELSE {_LABEL("hn", "hm")} END AS high FROM j),
labelled AS (SELECT fw, CASE WHEN low = high THEN low ELSE 'indeterminado' END AS security_level, ln AS cve_total, lm AS cvss_max, CASE WHEN nf THEN 'nao_encontrado' END AS evidence_reason FROM b)"""
_FEATURES = f"""f AS (SELECT firmware_id, meta_path, vendor, doc_id,
  CASE WHEN doc_id % 13 = 0 THEN 'erro' WHEN doc_id % 29 = 0 THEN 'timeout' ELSE 'ok' END AS meta_binwalk_status,
  CASE WHEN doc_id % 17 = 0 THEN 'falha' WHEN doc_id % 31 = 0 THEN NULL ELSE 'ok' END AS meta_unpack_status,
  CASE WHEN doc_id % 37 = 0 THEN 'odd' ELSE 'ok' END AS meta_fs_status, CASE WHEN doc_id % 19 = 0 THEN 'DD-WRT' END AS third
  FROM ({_ALIASES})),
u AS (SELECT DISTINCT firmware_id, n_chars % 7 = 0 AS undecided FROM ({_ALIASES}))"""

SQL = {
    "q_version_compare": f"SELECT l_orderkey, l_linenumber, {_V} = {_B} AS same, {_V} >= {_B} AS from_b, {_V} < {_B} AS before_b FROM lineitem",
    "q_version_infer": "SELECT p_partkey, name, version FROM ("
    + " UNION ALL ".join(
        f"SELECT p_partkey, {name} AS name, {version} AS version FROM part"
        for (_, name), version in zip(
            FILES,
            [
                "'1.0.' || p_size || '.80'", "'1.0.' || p_size", "'3.0.0.4.384.' || (10000 + p_size)", "'1.0.' || p_size",
                "CASE WHEN p_size = 14 THEN '1.14' END", "'3.' || p_size || '.2'", "NULL",
            ],
        )
    )
    + ")",
    "q_model_keys": "SELECT p_partkey, translate(lower(p_brand), '-_ ', '') || '/' || translate(lower(p_name), '-_ ', '') AS model_key, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS product FROM part",
    "q_search_variants": "SELECT p_partkey, unnest(['d-link DIR-' || p_size, 'dlink DIR-' || p_size, 'd-link DIR ' || p_size, 'dlink DIR ' || p_size, 'd-link DIR' || p_size, 'dlink DIR' || p_size]) AS variant FROM part",
    "q_kleene": """
WITH v AS (SELECT l_orderkey, CASE WHEN l_quantity <> 25 THEN l_quantity > 25 END AS v FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_or(v IS NOT NULL AND NOT v) THEN false WHEN bool_or(v IS NULL) THEN NULL ELSE true END AS all_of,
       CASE WHEN bool_or(v IS NOT NULL AND v) THEN true WHEN bool_or(v IS NULL) THEN NULL ELSE false END AS any_of FROM v GROUP BY l_orderkey""",
    "q_applicability": """
SELECT l_orderkey AS entry, l_linenumber AS cve_id, l_linenumber % 4 = 1 AS only_others,
  CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE
    CASE WHEN l_linenumber = 7 THEN (l_partkey % 9, l_suppkey % 5) < (l_quantity::INT % 9, 2) WHEN (l_partkey % 9, l_suppkey % 5) >= (l_quantity::INT % 9, 2) THEN false WHEN l_linenumber % 4 = 2 THEN true END END AS verdict
FROM lineitem""",
    "q_bounds_label": f"""
WITH judged AS (SELECT l_orderkey AS fw, l_partkey::VARCHAR AS cve_id, l_quantity / 5 AS score, CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS verdict, l_linenumber * 1000000 + l_suppkey AS nth FROM lineitem),
keys AS (SELECT o_orderkey AS fw, o_orderkey % 11 = 0 AS not_found FROM orders), {_BOUNDED} SELECT * FROM labelled""",
    "q_severity": f"""
WITH s AS (SELECT l_orderkey, l_quantity / 5 AS score, upper(CASE l_linenumber WHEN 1 THEN 'critical' WHEN 2 THEN 'High' WHEN 3 THEN 'none' ELSE l_returnflag END) AS b FROM lineitem),
g AS (SELECT l_orderkey, max(score) AS m, count(*) FILTER (b = 'CRITICAL') AS c, count(*) FILTER (b = 'HIGH') AS h, count(*) FILTER (b = 'MEDIUM') AS me, count(*) FILTER (b = 'LOW') AS lo, count(*) AS n FROM s GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(m, 0) AS cvss_max, coalesce(c, 0) AS cve_count_critical, coalesce(h, 0) AS cve_count_high, coalesce(me, 0) AS cve_count_medium, coalesce(lo, 0) AS cve_count_low, coalesce(n, 0) AS cve_total,
  {_LABEL("coalesce(n, 0)", "m")} AS label FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""",
    "q_labelled_aliases": f"""
WITH a AS ({_ALIASES}), judged AS (SELECT firmware_id AS fw, vendor AS cve_id, (n_chars % 10)::DOUBLE AS score, doc_id % 3 <> 0 AS verdict, doc_id AS nth FROM a),
keys AS (SELECT firmware_id AS fw, doc_id % 5 = 0 AS not_found FROM a), {_BOUNDED},
g AS (SELECT firmware_id AS fw, count(*) AS n, count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN vendor ELSE '' END) > 1 AS d FROM a GROUP BY ALL)
SELECT meta_path, security_level, cve_total, n AS alias_count, d AS versions_differ, CASE WHEN n = 1 THEN 'alias_unico' ELSE 'agregacao_conservadora' END AS label_strategy, evidence_reason
FROM a JOIN labelled ON fw = firmware_id JOIN g USING (fw)""",
    "q_semi_anti": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'some' ELSE 'none' END AS orders FROM customer",
    "q_checked_join": "SELECT lang, doc_id, quality, toxic, true AS known FROM documents LEFT JOIN labels USING (doc_id)",
    "q_full_reconcile": "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM documents)",
    "q_alias_collapse": f"SELECT firmware_id, arg_min(meta_path, doc_id) AS meta_path, any_value(n_chars) AS n_chars FROM ({_ALIASES}) GROUP BY firmware_id",
    "q_diverging_aliases": f"""SELECT firmware_id, concat_ws(',', CASE WHEN count(DISTINCT model) > 1 THEN 'model' END, CASE WHEN count(DISTINCT vendor) > 1 THEN 'vendor' END) AS columns
FROM ({_ALIASES}) GROUP BY firmware_id HAVING count(DISTINCT model) > 1 OR count(DISTINCT vendor) > 1""",
    "q_provenance": f"SELECT firmware_id, bool_or(doc_id % 2 = 0) AS in_table, string_agg(meta_path || '|' || vendor || '|' || model, ';' ORDER BY meta_path, vendor, model) AS aliases FROM ({_ALIASES}) GROUP BY firmware_id",
    "q_state_violations": f"""WITH {_FEATURES}
SELECT meta_path, 'meta_binwalk_status' AS "column", meta_binwalk_status AS value, 'transient' AS problem FROM f WHERE meta_binwalk_status = 'timeout'
UNION ALL SELECT meta_path, 'meta_unpack_status', meta_unpack_status, 'unknown' FROM f WHERE meta_unpack_status IS NULL
UNION ALL SELECT meta_path, 'meta_fs_status', meta_fs_status, 'unknown' FROM f WHERE meta_fs_status = 'odd'""",
    "q_exclusions": f"""WITH {_FEATURES},
r AS (SELECT firmware_id, 'falha_extracao' AS reason FROM f WHERE meta_binwalk_status = 'erro' OR meta_unpack_status = 'falha'
  UNION SELECT firmware_id, 'terceiros' FROM f WHERE third IS NOT NULL UNION SELECT firmware_id, 'indeterminado' FROM u WHERE undecided),
v AS (SELECT DISTINCT firmware_id, vendor FROM f)
SELECT NULL AS vendor, reason, count(*) AS n FROM r GROUP BY reason
UNION ALL SELECT vendor, NULL, count(DISTINCT firmware_id) FROM r JOIN v USING (firmware_id) GROUP BY vendor
UNION ALL SELECT vendor, reason, count(*) FROM r JOIN v USING (firmware_id) GROUP BY vendor, reason""",
    "q_undecided_share": f"""WITH {_FEATURES}, p AS (SELECT DISTINCT firmware_id, vendor FROM f)
SELECT vendor, count(*) FILTER (undecided) AS n, count(*) AS total, round(avg(undecided::INT), 4) AS share FROM p JOIN u USING (firmware_id) GROUP BY vendor""",
    "q_one_hot": """WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 7 <> 0 THEN lang END AS l FROM documents)
SELECT doc_id, source, coalesce(l = 'en', false)::TINYINT AS lang__en, coalesce(l = 'fr', false)::TINYINT AS lang__fr, coalesce(l NOT IN ('en', 'fr'), false)::TINYINT AS lang__outro, (l IS NULL)::TINYINT AS lang__ausente FROM d""",
    "q_multi_hot": """SELECT o_custkey, max((o_orderpriority = '1-URGENT')::TINYINT) AS "o_orderpriority__1-URGENT", max((o_orderpriority = '2-HIGH')::TINYINT) AS "o_orderpriority__2-HIGH", max((o_orderpriority = '5-LOW')::TINYINT) AS "o_orderpriority__5-LOW" FROM orders GROUP BY o_custkey""",
    "q_constant_columns": "SELECT unnest(['one', 'none']) AS \"column\"",
    "q_support": "SELECT quality AS class, count(*) AS n, count(DISTINCT source) AS n_groups FROM documents JOIN labels USING (doc_id) GROUP BY quality",
    "q_group_support": "SELECT source, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'fr') AS n_fr, count(*) FILTER (lang = 'de') AS n_de FROM documents GROUP BY source",
    "q_multiset_signature": """WITH s AS (SELECT o_custkey % 50 AS k, o_custkey % 100 < 50 AS half, count(*) AS n, list(o_orderstatus ORDER BY o_orderstatus) AS l FROM orders GROUP BY ALL)
SELECT k, sum(n)::BIGINT AS n, count(DISTINCT l) = 1 AS same FROM s GROUP BY k""",
    "q_finding_key": "SELECT doc_id, sha256(lang || chr(0) || source) AS finding_key FROM documents",
    "q_set_ops": """WITH cu AS (SELECT c_nationkey AS n FROM customer), su AS (SELECT s_nationkey AS n FROM supplier)
SELECT 'union' AS kind, count(*) AS n, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT n FROM cu UNION SELECT n FROM su)
UNION ALL SELECT 'both', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT n FROM cu INTERSECT SELECT n FROM su)
UNION ALL SELECT 'customers_only', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT n FROM cu EXCEPT SELECT n FROM su)
UNION ALL SELECT 'all', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT n FROM cu UNION ALL SELECT n FROM su)""",
    "q_difference": """WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0),
d AS (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT side, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM d GROUP BY side""",
    "q_prevalence": """WITH l AS (SELECT lang, unnest(['a', 'b', 'c']) AS "column", unnest([(doc_id % 3 = 0)::INT, CASE WHEN source <> 'src1' THEN (n_chars % 2)::INT END, CASE WHEN lang = 'en' THEN 1 END]) AS value FROM documents),
g AS (SELECT "column", lang, grouping(lang) AS a, count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing, count(*) FILTER (value > 0) AS n_present FROM l GROUP BY GROUPING SETS (("column"), ("column", lang)))
SELECT "column", CASE WHEN a = 1 THEN '*' ELSE lang END AS lang, n, n_missing, n_present, round(CASE WHEN n = n_missing THEN 'NaN'::DOUBLE ELSE n_present / (n - n_missing) END, 6) AS ratio FROM g""",
    "q_coverage": """WITH l AS (SELECT l_returnflag, l_linestatus, unnest(['quantity', 'price']) AS "column", unnest([CASE WHEN l_linenumber <> 2 THEN l_quantity END, l_extendedprice])::DOUBLE AS value FROM lineitem),
g AS (SELECT "column", l_returnflag, l_linestatus, grouping(l_linestatus) AS a, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, quantile_cont(value, [0.25, 0.5, 0.75]) AS q, avg(value) AS mean FROM l GROUP BY GROUPING SETS (("column", l_returnflag), ("column", l_returnflag, l_linestatus)))
SELECT l_returnflag, CASE WHEN a = 1 THEN '*' ELSE l_linestatus END AS l_linestatus, "column", n, missing, round(q[1], 6) AS q1, round(q[2], 6) AS median, round(q[3], 6) AS q3, round(mean, 6) AS mean, n < 5 AS is_small FROM g""",
}
