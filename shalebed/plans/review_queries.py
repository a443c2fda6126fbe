"""Queries of the manual review of findings, over line items as findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import versions
from ..operators import review
from ..sources.tables import table
from .metric_queries import _BOUND

#: A finding of each line item: every order is a firmware with up to two paths.
FINDING = {
    "line": "l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey",
    "detector": "CASE l_returnflag WHEN 'A' THEN 'urls' WHEN 'N' THEN 'api_tokens' ELSE 'telnetd' END",
    "firmware_id": "CAST(l_orderkey AS VARCHAR(20))",
    "path": "'v' || (l_orderkey % 4) || '/m' || (l_linenumber % 2) || '/f.bin'",
    "source": "l_linestatus || (l_partkey % 5)",
    "context": "'c' || (l_suppkey % 3)",
}
TARGET = 40


def _findings(spark, sf):
    found = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in FINDING.items()])
    excluded = found.where("source = 'F1'").select(review.finding_key("detector", "firmware_id", "source", "context").alias("finding_key"))
    return review.marked(found, excluded)


def q_alias_divergence(spark, sf):
    return review.differing_aliases(review.path_totals(_findings(spark, sf)))


def q_review_population(spark, sf):
    return review.population(review.path_totals(_findings(spark, sf)))


def q_population_summary(spark, sf):
    return review.population_summary(q_review_population(spark, sf))


def q_review_sheet(spark, sf):
    """Forty firmware for each detector, one finding of each, numbered in a drawn order."""
    findings = _findings(spark, sf)
    chosen = review.population(review.path_totals(findings))
    drawn = review.picks(chosen, review.quotas(chosen, TARGET), "7")
    items = review.picked(findings, drawn, "line").select("line", "detector", "vendor", "firmware_id", "path", "source", "context")
    return review.sheet(items, "7/order", "R-", "line", "v1").drop(*review.ANNOTATIONS)


#: An annotation of each document, from its number.
ANNOTATED = {
    "doc_id": "doc_id",
    "detector": "CASE lang WHEN 'en' THEN 'urls' WHEN 'de' THEN 'api_tokens' ELSE 'telnetd' END",
    "fabricante": "source",
    "classe": "CASE WHEN doc_id % 31 = 0 THEN 'talvez' WHEN doc_id % 5 = 0 THEN 'falso_positivo' WHEN doc_id % 7 = 0 THEN 'indeterminado' ELSE 'verdadeiro_candidato' END",
    "criterio": "CASE WHEN doc_id % 5 = 0 THEN 'F' || (doc_id % 3) WHEN doc_id % 7 = 0 THEN 'IND' ELSE 'V' || (doc_id % 2) END",
    "motivo_ind": "CASE WHEN doc_id % 11 = 0 THEN 'r9' WHEN doc_id % 7 = 0 AND doc_id % 5 <> 0 THEN 'r1' WHEN doc_id % 2 = 0 THEN '' END",
    "subtipo": "CASE WHEN lang = 'de' AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'key' || (doc_id % 4) ELSE '' END",
    "justificativa": "CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'seen' END",
    "data": "CASE WHEN doc_id % 17 = 0 THEN '2024-02-30' WHEN doc_id % 19 = 0 THEN 'x' WHEN doc_id % 23 = 0 THEN '2023-12-31' ELSE '2024-03-01' END",
    "rubrica_versao": "CASE WHEN doc_id % 29 = 0 THEN 'v0' ELSE 'v1' END",
}


def _annotated(spark, sf):
    return table(spark, sf, "documents").selectExpr(*[f"{e} AS {n}" for n, e in ANNOTATED.items()])


def q_annotation_errors(spark, sf):
    every = ["urls", "api_tokens", "telnetd"]
    errors = review.annotation_errors({d: ["V0", "V1"] for d in every}, {d: ["F0", "F1"] for d in every}, {"api_tokens": ["key1", "key2"]}, ["r1", "r2"], "v1", "2024-01-01")
    return _annotated(spark, sf).select("doc_id", F.array_join(errors, ",").alias("errors")).where("errors <> ''")


def q_review_summary(spark, sf):
    out = review.summary(_annotated(spark, sf), ["api_tokens", "public_ips", "telnetd", "urls"], cut=0.7)
    vendors = F.transform("by_vendor", lambda v: F.concat_ws(":", v["fabricante"], v["n_true"], v["n_false"], v["n_unsure"]))
    codes = F.transform("criteria", lambda c: F.concat_ws(":", c["criterio"], c["n"]))
    return out.withColumns({"by_vendor": F.array_join(vendors, ","), "criteria": F.array_join(codes, ","), "low": F.round("low", 6), "high": F.round("high", 6)})


#: Paths of the parts, some outside of the layout.
PATH = """CASE WHEN p_partkey % 11 = 0 THEN '/other/' WHEN p_partkey % 13 = 0 THEN '/data/extra/' ELSE '/data/' END || CASE WHEN p_partkey % 2 = 0 THEN 'Belkin' ELSE 'acme' END
 || '/X' || (p_partkey % 7) || CASE WHEN p_partkey % 3 = 0 THEN '_1.' || (p_partkey % 9) || '.b' ELSE '' END || '/' || CASE WHEN p_partkey % 5 = 0 THEN 'webflash' ELSE 'f' END || '_1.2.' || (p_partkey % 10) || '.bin'"""


def q_path_identity(spark, sf):
    paths = table(spark, sf, "part").selectExpr("p_partkey", f"{PATH} AS path")
    below = versions.relative_to(F.col("path"), F.lit("/data"))
    return paths.select("p_partkey", versions.off_layout(F.col("path"), F.lit("/data")).alias("off_layout"), versions.path_identity(below).alias("i")).select("p_partkey", "off_layout", "i.*")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

_MARKED = f"""f AS (SELECT *, sha256(detector || chr(0) || firmware_id || chr(0) || source || chr(0) || context) AS finding_key FROM (SELECT {", ".join(f"{e} AS {n}" for n, e in FINDING.items())} FROM lineitem)),
g AS (SELECT *, finding_key IN (SELECT finding_key FROM f WHERE source = 'F1') AS excluded FROM f),
t AS (SELECT detector, firmware_id, path, list_sort(list(finding_key)) AS keys, count(*) FILTER (NOT excluded) AS kept FROM g GROUP BY ALL)"""
_CHOSEN = f"{_MARKED}, c AS (SELECT detector, split_part(min(path), '/', 1) AS vendor, firmware_id, min(path) AS path, arg_min(kept, path) AS kept FROM t WHERE kept > 0 GROUP BY detector, firmware_id)"
_ANNOTATED = f"a AS (SELECT {', '.join(f'{e} AS {n}' for n, e in ANNOTATED.items())} FROM documents)"
_RULES = {
    "criterion": "criterio NOT IN ('V0', 'V1') AND classe = 'verdadeiro_candidato' OR criterio NOT IN ('F0', 'F1') AND classe = 'falso_positivo' OR criterio <> 'IND' AND classe = 'indeterminado'",
    "reason_presence": "(classe = 'indeterminado') <> (coalesce(motivo_ind, '') <> '')",
    "reason": "classe = 'indeterminado' AND motivo_ind = 'r9'",
    "subtype": "CASE WHEN detector = 'api_tokens' AND classe = 'verdadeiro_candidato' THEN subtipo NOT IN ('key1', 'key2') ELSE subtipo <> '' END",
    "justification": "trim(justificativa) = ''",
    "rubric_version": "rubrica_versao <> 'v1'",
    "date": "try_cast(data AS DATE) IS NULL",
    "date_before_rubric": "try_cast(data AS DATE) < DATE '2024-01-01'",
}
_COUNTS = "count(*) FILTER (classe = 'verdadeiro_candidato') AS n_true, count(*) FILTER (classe = 'falso_positivo') AS n_false, count(*) FILTER (classe = 'indeterminado') AS n_unsure"
_LOW, _HIGH = (_BOUND(sign).replace("yes", "n_true") for sign in "-+")

SQL = {
    "q_alias_divergence": f"WITH {_MARKED} SELECT detector, firmware_id FROM t GROUP BY ALL HAVING count(DISTINCT keys) > 1",
    "q_review_population": f"WITH {_CHOSEN} SELECT * FROM c",
    "q_population_summary": f"WITH {_CHOSEN} SELECT detector, vendor, count(*) AS n_firmware, sum(kept) AS n_findings FROM c GROUP BY ALL",
    "q_review_sheet": f"""WITH {_CHOSEN}, h AS (SELECT *, sha256('7/' || detector || '/' || firmware_id) AS h FROM c),
p AS (SELECT *, ('0x' || substr(h, 9, 12))::BIGINT % kept AS nth FROM h QUALIFY row_number() OVER (PARTITION BY detector, vendor ORDER BY h, firmware_id) <= {TARGET // 4}),
n AS (SELECT g.*, vendor, nth, row_number() OVER (PARTITION BY detector, firmware_id, path ORDER BY line) - 1 AS place FROM g JOIN p USING (detector, firmware_id, path) WHERE NOT excluded)
SELECT 'R-' || printf('%03d', row_number() OVER (ORDER BY sha256('7/order/' || line))) AS item_id, line, detector, vendor, firmware_id, path, source, context, sha256(source) AS source_sha256, 'v1' AS rubrica_versao FROM n WHERE place = nth""",
    "q_annotation_errors": f"""WITH {_ANNOTATED}, e AS (SELECT doc_id, CASE WHEN classe = 'talvez' THEN 'class' ELSE concat_ws(',', {", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _RULES.items())}) END AS errors FROM a)
SELECT * FROM e WHERE errors <> ''""",
    "q_review_summary": f"""WITH {_ANNOTATED}, d AS (SELECT unnest(['api_tokens', 'public_ips', 'telnetd', 'urls']) AS detector), s AS (SELECT detector, {_COUNTS} FROM d LEFT JOIN a USING (detector) GROUP BY detector),
v AS (SELECT detector, string_agg(concat_ws(':', fabricante, n_true, n_false, n_unsure), ',' ORDER BY fabricante) AS by_vendor FROM (SELECT detector, fabricante, {_COUNTS} FROM a GROUP BY ALL) GROUP BY detector),
k AS (SELECT detector, string_agg(criterio || ':' || n, ',' ORDER BY criterio) AS criteria FROM (SELECT detector, criterio, count(*) AS n FROM a GROUP BY ALL) GROUP BY detector),
w AS (SELECT *, (n_true + n_false)::DOUBLE AS n FROM s), b AS (SELECT *, CASE WHEN n > 0 THEN greatest(0, {_LOW}) END AS low, CASE WHEN n > 0 THEN least(1, {_HIGH}) END AS high FROM w),
r AS (SELECT *, CASE WHEN n + n_unsure = 0 THEN 'absent' WHEN n_unsure > (n + n_unsure) * 0.5 THEN 'too many unsure' WHEN n < 20 THEN 'too few decided' WHEN low >= 0.7 THEN 'low end reaches cut' WHEN high < 0.7 THEN 'high end below cut' ELSE 'interval holds cut' END AS reason FROM b)
SELECT detector, n_true, n_false, n_unsure, CASE reason WHEN 'absent' THEN NULL WHEN 'low end reaches cut' THEN 'manter' WHEN 'high end below cut' THEN 'retirar' ELSE 'reformular' END AS decision, reason, round(low, 6) AS low, round(high, 6) AS high, by_vendor, criteria
FROM r LEFT JOIN v USING (detector) LEFT JOIN k USING (detector)""",
    "q_path_identity": f"""WITH p AS (SELECT p_partkey, {PATH} AS path FROM part), x AS (SELECT *, p_partkey % 11 = 0 OR p_partkey % 13 = 0 AS off_layout, p_partkey % 5 = 0 AS third, p_partkey % 3 = 0 AS versioned, p_partkey % 2 = 0 AS belkin FROM p),
y AS (SELECT *, CASE WHEN belkin THEN 'belkin' ELSE 'acme' END AS b, 'x' || (p_partkey % 7) AS m FROM x)
SELECT p_partkey, off_layout, CASE WHEN NOT off_layout THEN b END AS brand, CASE WHEN NOT off_layout THEN m END AS model, CASE WHEN NOT off_layout THEN b || '_' || m END AS label,
  CASE WHEN off_layout OR third THEN NULL WHEN versioned THEN '1.' || (p_partkey % 9) || '.b' WHEN belkin THEN '1.2.' || (p_partkey % 10) END AS version,
  CASE WHEN off_layout OR third THEN NULL WHEN versioned THEN 'directory' WHEN belkin THEN 'filename' END AS version_source FROM y""",
}
