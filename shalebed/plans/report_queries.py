"""Queries of report tables and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, corpus, metrics, report
from ..sources.tables import table
from .metric_queries import CLASSES, _macro, _P, _predictions

N = 2000


def _arms(spark, sf):
    """Three arms: by length, by signs, and one that always says 1."""
    return _predictions(spark, sf).withColumn("c", F.lit("1"))


def _resamples(spark, sf):
    """Draws of the sources that are arithmetic, so that SQL draws them too."""
    rank = _predictions(spark, sf).select("source").distinct().withColumn("rank", F.regexp_extract("source", r"(\d+)", 1).cast("long") % 20)
    i = F.col("id")
    r, j = F.floor(i / 20), i % 20
    draws = spark.range(N * 20).select(r.alias("resample"), ((r * 7919 + j * 104729 + r * j * 31) % 20).alias("rank"))
    return draws.join(rank, "rank").groupBy("resample", "source").agg(F.count(F.lit(1)).alias("k"))


def _rounded(df):
    return df.withColumns({n: F.round(n, 6) for n, t in df.dtypes if t == "double"})


def _comparison(spark, sf):
    return report.comparison_table(_arms(spark, sf), _resamples(spark, sf), "source", "y", ["a", "b", "c"], ["b", "c"], CLASSES, ("b", "c"))


def _scenarios(spark, sf):
    return report.scenario_table(_arms(spark, sf), _resamples(spark, sf), "source", "y", "b", "c", "lang", "de", CLASSES)


def q_comparison_table(spark, sf):
    return _rounded(_comparison(spark, sf))


def q_ablation_table(spark, sf):
    return _rounded(report.ablation_table(_arms(spark, sf), _resamples(spark, sf), "source", "y", {"b": ["n_chars"], "c": ["n_chars", "text"]}, "a", CLASSES))


def q_scenario_table(spark, sf):
    return _rounded(_scenarios(spark, sf))


def q_delta_rows(spark, sf):
    parts = [(_comparison(spark, sf), F.concat_ws(" - ", "arm", "reference_arm")), (_scenarios(spark, sf), F.col("scenario"))]
    return _rounded(report.delta_rows(parts))


def q_exclusion_table(spark, sf):
    """Reasons of each order from its key; the vendor is its priority."""
    k = F.col("o_orderkey")
    reasons = F.array(F.when(k % 3 == 0, "falha_extracao"), F.when(k % 5 == 0, "terceiros"), F.when(k % 7 == 0, "indeterminado"))
    return _rounded(report.exclusion_table(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("vendor"), reasons.alias("reasons"))))


def q_vendor_table(spark, sf):
    """Languages as vendors, sources as groups."""
    return _rounded(report.vendor_table(_arms(spark, sf), "lang", "source", "y", ["a", "b", "c"], CLASSES))


def q_vendor_merge(spark, sf):
    """Files of three vendors from parts: some models become one, some are taken, some lie too deep."""
    k, size = F.col("p_partkey"), F.col("p_size")
    vendor = F.element_at(F.array(F.lit("tplink"), F.lit("tplink"), F.lit("tp_link"), F.lit("dlink")), (k % 4 + 1).cast("int"))
    sign = F.when((size % 10 == 3) & (k % 8 < 4), "-").otherwise("_")
    model = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("archer"), sign, size)).otherwise(F.concat(F.when(vendor == "tp_link", "re").otherwise("wr"), F.lit("_"), size))
    deep = F.when(k % 25 == 1, F.lit("old/")).otherwise("")
    paths = table(spark, sf, "part").select(F.concat(vendor, F.lit("/"), F.when(vendor == "tp_link", F.replace(model, F.lit("_"), F.lit("-"))).otherwise(model), F.lit("/"), deep, F.lit("f"), k).alias("path"))
    return corpus.vendor_merge(paths, "tplink", "tp_link")


def q_scoring_features(spark, sf):
    """Orders are asked for by customers' numbers; line items are aliases."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 2, "0")).alias("place"), F.lit(1).alias("seen"))
    ids = table(spark, sf, "customer").select((F.col("c_custkey") % 500).alias("id"))
    return corpus.scoring_features(li, ids, "id", ["seen"], "place")


def q_missing_classes(spark, sf):
    """Customers without orders of every status."""
    missing = report.missing_classes(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"])
    return missing.select("o_custkey", F.array_join("missing", ",").alias("missing"))


def q_one_hot(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *report.one_hot(F.col("o_orderstatus"), ["F", "O", "P"]))


def q_importance_table(spark, sf):
    """Drops of event types by user, users taken as folds."""
    drops = table(spark, sf, "events").select(F.col("event_type").alias("feature"), F.col("user_id").alias("fold"), F.col("value").alias("drop"))
    return _rounded(report.importance_table(drops))


def q_table_issues(spark, sf):
    """Documents with labels as a feature table that breaks most rules."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    t = d.select((F.col("doc_id") / 2).cast("long").alias("firmware_id"), F.col("quality").cast("string").alias("level"), "lang", F.col("n_chars").alias("meta_chars"), F.col("toxic").alias("count_api_tokens"), F.col("source").alias("fs_type"))
    return checks.table_issues(t, "firmware_id", "level", ["0", "1"])


def q_vendor_issues(spark, sf):
    """Parts that several suppliers, or none, deliver."""
    aliases = table(spark, sf, "lineitem").select("l_partkey", F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey")).alias("vendor"))
    return checks.vendor_issues(aliases, "l_partkey", "vendor", table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey")))


def q_input_issues(spark, sf):
    documents = table(spark, sf, "documents").withColumn("doc_id", F.when(F.col("doc_id") % 50 != 0, F.col("doc_id")))
    return checks.input_issues(documents, table(spark, sf, "labels"), "doc_id", ["lang", "vendor"], ["quality", "level"])


def q_out_of_fold_frame(spark, sf):
    """Orders tested by their key; groups are customers, vendors priorities."""
    o = table(spark, sf, "orders")
    folds = o.select("o_orderkey", F.col("o_custkey").alias("group"), F.explode(F.array(F.lit("test"), F.lit("train"))).alias("role"))
    return checks.out_of_fold_frame(folds, o.select("o_orderkey", F.col("o_orderpriority").alias("vendor")), "o_orderkey", "vendor", "none", ["none"])


def q_encoded(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return checks.encoded(table(spark, sf, "supplier"), "s_nationkey", nations, "nation").select("s_suppkey", "nation")


def q_vendor_models(spark, sf):
    """Distinct pairs of brand and type, trimmed and lower-cased; blanks go."""
    p = table(spark, sf, "part").select(F.concat(F.lit(" "), "p_brand").alias("brand"), F.when(F.col("p_partkey") % 3 != 0, F.upper("p_type")).otherwise(" ").alias("model"))
    clean = p.select(*[F.lower(F.trim(x)).alias(x) for x in ("brand", "model")])
    return clean.where("brand <> '' AND model <> ''").distinct().orderBy("brand", "model")


def q_distribution(spark, sf):
    """Orders by status, with one that never occurs and null."""
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("status"))
    return report.distribution(o, "status", ["F", "O", "P", "none", None])


def q_alias_counts(spark, sf):
    """Customers as ids, their orders as aliases."""
    o = table(spark, sf, "orders").select("o_custkey", F.concat(F.lit(" M"), F.col("o_orderkey") % 3).alias("model"), (F.col("o_orderkey") % 50 == 0).alias("differ"))
    return report.alias_counts(o, "o_custkey", "model", "differ")


def q_by_first_row(spark, sf):
    return report.by_first_row(table(spark, sf, "events"), "user_id", "event_id")


def q_token_preview(spark, sf):
    """The first tokens of every document."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 20), " ").alias("tokens"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

_DRAWS = f"""{_P}, arms AS (SELECT *, '1' AS c FROM p), d AS (SELECT i // 20 AS resample, ((i // 20) * 7919 + (i % 20) * 104729 + (i // 20) * (i % 20) * 31) % 20 AS rank FROM range({N * 20}) t(i)),
s AS (SELECT resample, source, count(*) AS k FROM d JOIN (SELECT DISTINCT source FROM p) n ON regexp_extract(source, '(\\d+)', 1)::BIGINT % 20 = rank GROUP BY ALL)"""


def _compared(name: str, rows: str, key: str, first: str, second: str, w: str = "1.0::DOUBLE") -> str:
    """Tables of a comparison of two columns of rows, by a constant key."""
    return f"""{name}_r AS (SELECT resample, {_macro(first, f'{w} * k')} AS f, {_macro(second, f'{w} * k')} AS g FROM {rows} JOIN s USING (source) GROUP BY resample),
{name} AS (SELECT {key}, f AS first, g AS second, f - g AS delta, qf[1] AS first_low, qf[2] AS first_high, qg[1] AS second_low, qg[2] AS second_high, qd[1] AS delta_low, qd[2] AS delta_high
FROM (SELECT {_macro(first, w)} AS f, {_macro(second, w)} AS g FROM {rows}), (SELECT quantile_cont(f, [0.025, 0.975]) AS qf, quantile_cont(g, [0.025, 0.975]) AS qg, quantile_cont(f - g, [0.025, 0.975]) AS qd FROM {name}_r))"""


def _pair_tables(pairs: list[tuple[str, str]]) -> str:
    parts = ",\n".join(_compared(f"x_{a}_{b}", "arms", f"'{a}' AS arm, '{b}' AS reference_arm", a, b) for a, b in pairs)
    return f"{parts}, pairs AS ({' UNION ALL '.join(f'SELECT * FROM x_{a}_{b}' for a, b in pairs)})"


_ROUND = lambda *names: ", ".join(f"round({a}, 6) AS {b}" for a, b in (n if isinstance(n, tuple) else (n, n) for n in names))
_SHOWN = _ROUND(("first", "macro_f1"), ("first_low", "macro_f1_low"), ("first_high", "macro_f1_high"), ("second", "reference_macro_f1"), "delta", "delta_low", "delta_high")
_CORE = _pair_tables([("a", "b"), ("c", "b"), ("a", "c"), ("b", "c")])
_SCENARIOS = (
    "w AS (SELECT *, 1.0::DOUBLE AS w_all, CASE WHEN lang = 'de' THEN 0.0 ELSE 1.0 END::DOUBLE AS w_without, (1.0 / count(*) OVER (PARTITION BY source))::DOUBLE AS w_group FROM arms),\n"
    + ",\n".join(_compared(w, "w", f"'{name}' AS scenario", "b", "c", w) + f", {w}_n AS (SELECT count(*) FILTER ({w} > 0) AS n, count(DISTINCT source) FILTER ({w} > 0) AS n_groups FROM w)" for w, name in (("w_all", "all"), ("w_without", "without_vendor"), ("w_group", "group_as_one")))
    + ", scenarios AS ("
    + " UNION ALL ".join(f"SELECT * FROM {w}, {w}_n" for w in ("w_all", "w_without", "w_group"))
    + ")"
)

SQL = {
    "q_vendor_table": f"""WITH {_P}, arms AS (SELECT lang, source, y, unnest(['a', 'b', 'c']) AS arm, unnest([a, b, '1']) AS t FROM p),
    n AS (SELECT lang, y, count(DISTINCT source) AS n_components FROM p GROUP BY ALL),
    g AS (SELECT lang, arm, k AS true_class, count(*) FILTER (y = k) AS support, count(*) FILTER (t = k) AS told, count(*) FILTER (y = k AND t = k) AS hit,
      count(*) FILTER (y = k AND t = '0') AS pred__0, count(*) FILTER (y = k AND t = '1') AS pred__1 FROM arms, (VALUES ('0'), ('1')) c(k) GROUP BY ALL)
    SELECT g.lang, arm, true_class, support, coalesce(n_components, 0) AS n_components, round(coalesce(hit / nullif(told, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall,
      round(coalesce(2.0 * hit / nullif(told + support, 0), 0), 6)::DOUBLE AS f1, concat_ws(';', CASE WHEN told = 0 THEN 'precision' END, CASE WHEN support = 0 THEN 'recall' END) AS undefined, pred__0, pred__1
    FROM g LEFT JOIN n ON n.lang = g.lang AND n.y = true_class""",
    "q_vendor_merge": """
WITH v AS (SELECT p_partkey AS k, p_size AS s, ['tplink', 'tplink', 'tp_link', 'dlink'][p_partkey % 4 + 1] AS vendor FROM part),
m AS (SELECT *, CASE WHEN s % 3 = 0 THEN 'archer' || CASE WHEN s % 10 = 3 AND k % 8 < 4 THEN '-' ELSE '_' END || s ELSE CASE WHEN vendor = 'tp_link' THEN 're' ELSE 'wr' END || '_' || s END AS model, k % 25 = 1 AS nested FROM v),
t AS (SELECT DISTINCT replace(model, '_', '-') AS model FROM m WHERE vendor = 'tp_link'),
two AS (SELECT replace(model, '_', '-') AS model FROM m WHERE vendor = 'tplink' AND NOT nested GROUP BY 1 HAVING count(DISTINCT m.model) > 1)
SELECT vendor || '/' || model || '/' || CASE WHEN nested THEN 'old/' ELSE '' END || 'f' || k AS source,
  CASE WHEN NOT nested THEN 'tp_link/' || replace(model, '_', '-') || '/f' || k END AS moved_to,
  CASE WHEN nested THEN 'nested' WHEN replace(model, '_', '-') IN (SELECT model FROM two) THEN 'two_sources' WHEN replace(model, '_', '-') IN (SELECT model FROM t) THEN 'occupied' END AS problem
FROM m WHERE vendor = 'tplink'""",
    "q_scoring_features": """
WITH ids AS (SELECT DISTINCT c_custkey % 500 AS id FROM customer), f AS (SELECT l_orderkey AS id, min(lpad(l_linenumber::VARCHAR, 2, '0')) AS place FROM lineitem GROUP BY ALL)
SELECT id, place, CASE WHEN place IS NOT NULL THEN 1 END AS seen FROM ids LEFT JOIN f USING (id)""",
    "q_comparison_table": f"""WITH {_DRAWS}, {_CORE} SELECT arm, reference_arm, {_SHOWN}, arm = 'b' AND reference_arm = 'c' AS anchor,
  CASE WHEN arm <> 'b' OR reference_arm <> 'c' THEN '' WHEN delta <= 0 THEN 'nulo_ou_negativo' WHEN delta_low > 0 THEN 'supera_b1' ELSE 'inconclusivo' END AS interpretation FROM pairs""",
    "q_ablation_table": f"""WITH {_DRAWS}, {_pair_tables([("b", "a"), ("c", "a")])} SELECT arm, reference_arm, {_SHOWN}, CASE arm WHEN 'b' THEN 'n_chars' ELSE 'n_chars;text' END AS removed_columns,
  CASE WHEN delta_high < 0 THEN 'queda' ELSE 'sem_queda_conclusiva' END AS interpretation FROM pairs""",
    "q_scenario_table": f"""WITH {_DRAWS}, {_SCENARIOS} SELECT scenario, {_ROUND("first", "second", "delta", "first_low", "first_high", "second_low", "second_high", "delta_low", "delta_high")}, n, n_groups, 'aplicável' AS status FROM scenarios""",
    "q_delta_rows": f"""WITH {_DRAWS}, {_CORE}, {_SCENARIOS} SELECT arm || ' - ' || reference_arm AS label, {_ROUND("delta", "delta_low", "delta_high")} FROM pairs
UNION ALL SELECT scenario, {_ROUND("delta", "delta_low", "delta_high")} FROM scenarios""",
    "q_exclusion_table": """SELECT o_orderpriority AS vendor, count(*) FILTER (o_orderkey % 3 = 0) AS falha_extracao, count(*) FILTER (o_orderkey % 5 = 0) AS terceiros, count(*) FILTER (o_orderkey % 7 = 0) AS indeterminado,
  count(*) AS total_ids, round(count(*) FILTER (o_orderkey % 7 = 0) / count(*), 6) AS proporcao_indeterminado FROM orders GROUP BY ALL""",
    "q_missing_classes": """WITH m AS (SELECT o_custkey, concat_ws(',', CASE WHEN NOT bool_or(o_orderstatus = 'F') THEN 'F' END, CASE WHEN NOT bool_or(o_orderstatus = 'O') THEN 'O' END, CASE WHEN NOT bool_or(o_orderstatus = 'P') THEN 'P' END) AS missing FROM orders GROUP BY ALL)
SELECT * FROM m WHERE missing <> ''""",
    "q_one_hot": "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderstatus = '{x}' THEN 1.0 ELSE 0.0 END::DOUBLE AS proba__{x}" for x in "FOP") + " FROM orders",
    "q_importance_table": """SELECT event_type AS feature, round(avg(value), 6) AS mean_drop, round(stddev_samp(value), 6) AS std_drop, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high, count(value) AS n_folds
FROM events GROUP BY ALL""",
    "q_table_issues": """WITH t AS (SELECT doc_id // 2 AS id, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT * FROM (VALUES ('text', 'lang'), ('forbidden', 'meta_chars'), ('demoted', 'count_api_tokens'), ('forbidden', 'fs_type'), ('text', 'fs_type')) v(problem, detail)
UNION ALL SELECT 'repeated', id::VARCHAR FROM t GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'target', quality::VARCHAR FROM t WHERE quality IS NULL OR quality NOT IN (0, 1)""",
    "q_vendor_issues": """WITH a AS (SELECT l_partkey, CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey END AS vendor FROM lineitem),
g AS (SELECT l_partkey, CASE WHEN count(DISTINCT vendor) > 1 THEN 'several' WHEN bool_or(vendor IS NULL) THEN 'null' END AS problem FROM a GROUP BY l_partkey)
SELECT * FROM g WHERE problem IS NOT NULL UNION ALL SELECT p_partkey, 'no alias' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""",
    "q_input_issues": """WITH f AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 50 <> 0)
SELECT * FROM (VALUES ('missing column', 'features', 'vendor'), ('missing column', 'labels', 'level'), ('null key', 'features', 'doc_id')) v(problem, side, detail)
UNION ALL SELECT 'unmatched', 'features', doc_id::VARCHAR FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT 'unmatched', 'labels', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM f)""",
    "q_out_of_fold_frame": "SELECT o_orderkey, o_custkey AS \"group\", count(*) OVER (PARTITION BY o_custkey) AS group_size, o_orderpriority AS vendor, false AS has_excluded FROM orders",
    "q_encoded": "SELECT s_suppkey, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "q_vendor_models": "SELECT DISTINCT lower(trim(p_brand)) AS brand, lower(p_type) AS model FROM part WHERE p_partkey % 3 <> 0 AND trim(p_brand) <> ''",
    "q_distribution": """WITH o AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS status FROM orders)
SELECT v.status, (SELECT count(*) FROM o WHERE o.status IS NOT DISTINCT FROM v.status) AS n FROM (VALUES ('F'), ('O'), ('P'), ('none'), (NULL)) v(status)""",
    "q_alias_counts": """SELECT count(*) FILTER (n > 1) AS several_aliases, count(*) FILTER (m > 1) AS several_models, count(*) FILTER (d) AS differing_versions
FROM (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderkey % 3) AS m, bool_or(o_orderkey % 50 = 0) AS d FROM orders GROUP BY ALL)""",
    "q_by_first_row": "SELECT user_id, min(event_id) AS first_row FROM events GROUP BY ALL",
    "q_token_preview": "SELECT doc_id, array_to_string(string_split(text, ' ')[1:20], ' ') AS tokens FROM documents",
}
