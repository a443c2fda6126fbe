"""Queries of groups, folds, metrics, bootstrap, rule score and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors, groups, metrics, quantiles, sampling, score
from ..sources.tables import table
from .detector_queries import _COMPOSED_SQL, composed

CLASSES = ["0", "1"]


def _predictions(spark, sf):
    """Labelled documents with the predictions of two rules; group is the source."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(
        "doc_id", "source", "lang", F.col("quality").cast("string").alias("y"),
        (F.col("n_chars") > 700).cast("int").cast("string").alias("a"),
        (~F.col("text").rlike("[$%#&]")).cast("int").cast("string").alias("b"),
    )


def _rounded(df, *columns):
    return df.withColumns({x: F.round(x, 6) for x in columns})


def q_confusion(spark, sf):
    m = metrics.confusion(_predictions(spark, sf), ["lang"], "y", "b", CLASSES)
    rows = metrics.class_metrics(m, ["lang"], CLASSES).withColumn("undefined", F.array_join("undefined", ","))
    return _rounded(rows, "precision", "recall", "f1")


def q_macro_f1(spark, sf):
    m = metrics.confusion(_predictions(spark, sf), ["lang"], "y", "a", CLASSES)
    return _rounded(metrics.macro_metrics(m, ["lang"], CLASSES), "accuracy", "macro_f1", "balanced_accuracy")


def q_weighted_f1(spark, sf):
    p = metrics.scenario_weights(_predictions(spark, sf), "source", "src0", "source")
    out = None
    for w in ("w_all", "w_without", "w_group"):
        one = metrics.weighted_macro_f1(p, ["lang"], "y", "b", CLASSES, F.col(w)).withColumn("scenario", F.lit(w))
        out = one if out is None else out.unionByName(one)
    return _rounded(out, "macro_f1")


def q_bootstrap(spark, sf):
    """2,000 resamples of the sources whose draws are arithmetic, so that SQL draws them too."""
    p = _predictions(spark, sf)
    names = p.select("source").distinct()
    rank = names.select("source", (F.regexp_extract("source", r"(\d+)", 1).cast("long") % 20).alias("rank"))
    draws = spark.range(2000 * 20).select(
        F.floor(F.col("id") / 20).alias("resample"), ((F.floor(F.col("id") / 20) * 7919 + (F.col("id") % 20) * 104729 + F.floor(F.col("id") / 20) * (F.col("id") % 20) * 31) % 20).alias("rank")
    )
    resamples = draws.join(rank, "rank").groupBy("resample", "source").agg(F.count(F.lit(1)).alias("k"))
    out = metrics.paired_bootstrap(p, resamples, "source", "y", "a", "b", CLASSES)
    return _rounded(out, *out.columns)


def q_bootstrap_drawn(spark, sf):
    """2,000 resamples drawn by the operator."""
    p = _predictions(spark, sf)
    return metrics.paired_bootstrap(p, metrics.draw_resamples(p, "source", 2000), "source", "y", "a", "b", CLASSES)


def q_quantiles(spark, sf):
    """Quartiles and the ends of the middle 95 of 100 of prices, for three groups that hold a third of the rows each."""
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"), F.lit(1).alias("n"))
    q = quantiles.quantiles(li, ["l_returnflag"], "price", "n", [0.025, 0.25, 0.5, 0.75, 0.975])
    return q.select("l_returnflag", *[F.round(F.get("q", i), 4).alias(n) for i, n in enumerate(["low", "q1", "median", "q3", "high"])])


def q_majority(spark, sf):
    return metrics.majority_class(_predictions(spark, sf), ["lang"], "y", ["1", "0"])


def q_invalid_predictions(spark, sf):
    p = _predictions(spark, sf).withColumn("b", F.when(F.col("doc_id") % 10 != 0, F.col("b")))
    return metrics.invalid_predictions(p.unionByName(p.where("doc_id % 7 = 0")), ["doc_id"], ["y", "b"], CLASSES)


def q_components(spark, sf):
    """Orders that share parts, directly or over others."""
    return groups.connected_groups(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


def _links(spark, sf):
    """Orders and their customers, whose groups stay apart."""
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey")


def _folds(spark, sf):
    labelled = groups.connected_groups(_links(spark, sf), "o_orderkey", "o_custkey").join(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return labelled, groups.grouped_folds(labelled, "o_orderkey", "group", "o_orderstatus", 5, seed=42)


def q_folds(spark, sf):
    return _folds(spark, sf)[1]


def q_fold_checks(spark, sf):
    """How many ids and models cross folds or aren't tested once; none should."""
    _, folds = _folds(spark, sf)
    crossing = groups.crossings(folds, _links(spark, sf), "o_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("crossings"))
    return crossing.crossJoin(groups.not_tested_once(folds, "o_orderkey").agg(F.count(F.lit(1)).alias("not_once")))


def q_fold_summary(spark, sf):
    labelled, folds = _folds(spark, sf)
    return groups.fold_summary(folds, labelled, "o_orderkey", "o_orderstatus", ["F", "O", "P"])


#: Features of an order, from its key, in both engines.
FEATURES = {
    "entropy": "CASE WHEN k % 9 <> 0 THEN 5 + (k % 40) / CAST(10 AS DOUBLE) END",
    "compress_ratio": "CASE WHEN k % 9 <> 1 THEN (k % 120) / CAST(100 AS DOUBLE) END",
    "byte_mean": "CAST(k % 256 AS DOUBLE)",
    "count_hardcoded_passwords": "k % 6 - 3",
    "count_credential_pairs": "k % 4",
    "count_non_public_ips": "CASE WHEN k % 5 <> 0 THEN k % 3 END",
    "count_public_ips": "k % 2",
    "has_outdated_libssl": "k % 3 = 0",
    "has_outdated_busybox": "CASE WHEN k % 4 <> 0 THEN k % 5 = 0 END",
    "has_encrypted_sections": "k % 8 = 0",
    "n_crypto_signatures": "k % 9",
    "entropy_variance_across_sections": "(k % 50) / CAST(10 AS DOUBLE)",
    "fs_type": "CASE k % 4 WHEN 0 THEN 'squashfs' WHEN 1 THEN 'JFFS2' WHEN 2 THEN 'cramfs' END",
    "compression_type": "CASE WHEN k % 2 = 0 THEN 'gzip' ELSE 'lzma' END",
    "n_filesystems": "k % 5",
    "has_telnetd": "k % 10 = 0",
    "has_debug_account": "k % 7 = 0",
}


def q_rule_score(spark, sf):
    k = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    f = k.select("k", *[F.expr(e).alias(n) for n, e in FEATURES.items()])
    s = score.rule_score(f).withColumn("hard_rules", F.array_join("hard_rules", ","))
    return _rounded(s.select("k", "score_stats", "score_strings", "score_binwalk", "score", "level", "hard_rule", "hard_rules", "missing_ignored"), "score_stats", "score_strings", "score_binwalk", "score")


def _reviews(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("yes"), F.count_if(F.col("quality") == 0).alias("no"), F.count_if(F.col("quality").isNull()).alias("unsure"))


def q_wilson(spark, sf):
    low, high = sampling.wilson(F.col("yes"), F.col("yes") + F.col("no"))
    return _rounded(_reviews(spark, sf).select("source", low.alias("low"), high.alias("high")), "low", "high")


def q_decide(spark, sf):
    return _reviews(spark, sf).select("source", sampling.decide(F.col("yes"), F.col("no"), F.col("unsure"), 0.7, 3, 0.7).alias("decision"))


def q_allocate(spark, sf):
    return sampling.allocation(table(spark, sf, "documents"), "lang", 150)


def q_draw(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.draw(d, "doc_id", "lang", sampling.allocation(d, "lang", 60), "0/urls")


def q_ordinal_fetch(spark, sf):
    """The third event of each user and type."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return sampling.nth_of(e, ["user_id", "event_type"], "event_id").where("nth = 2").select("user_id", "event_type", "event_id")


def q_redact(spark, sf):
    asked = [d for d in detectors.DETECTORS if d.name in ("hardcoded_passwords", "telnetd")]
    found = detectors.find(composed(spark, sf), ["k", "pos"], detectors=asked, fields=["source", "detector"])
    told = sampling.redacted(F.col("detector"), F.col("source")).alias("shown")
    return found.select("k", F.col("pos").cast("long").alias("pos"), "detector", told)


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

_P = """p AS (SELECT doc_id, source, lang, quality::VARCHAR AS y, ((n_chars > 700)::INT)::VARCHAR AS a, ((NOT regexp_matches(text, '[$%#&]'))::INT)::VARCHAR AS b FROM documents JOIN labels USING (doc_id))"""


def _f1_sql(k: str, predicted: str, w: str = "1") -> str:
    return f"coalesce(2.0 * sum({w}) FILTER (y = '{k}' AND {predicted} = '{k}') / nullif(coalesce(sum({w}) FILTER (y = '{k}'), 0) + coalesce(sum({w}) FILTER ({predicted} = '{k}'), 0), 0), 0)"


def _macro(predicted: str, w: str = "1") -> str:
    return f"({_f1_sql('0', predicted, w)} + {_f1_sql('1', predicted, w)}) / 2"


_CLASS_SQL = " UNION ALL ".join(
    f"""SELECT lang, '{k}' AS class, round(coalesce(tp / nullif(pr, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tr, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(pr + tr, 0), 0), 6) AS f1, tr AS support,
  concat_ws(',', CASE WHEN pr = 0 THEN 'precision' END, CASE WHEN tr = 0 THEN 'recall' END, CASE WHEN pr + tr = 0 THEN 'f1' END) AS undefined
FROM (SELECT lang, count(*) FILTER (y = '{k}' AND b = '{k}') AS tp, count(*) FILTER (b = '{k}') AS pr, count(*) FILTER (y = '{k}') AS tr FROM p GROUP BY lang)"""
    for k in CLASSES
)
_SCORE = {
    "stats": ["(CASE WHEN entropy IS NOT NULL THEN least(1, greatest(0, (entropy - 6.0) / 2.0)) END)", "(CASE WHEN compress_ratio IS NOT NULL THEN least(1, greatest(0, (compress_ratio - 0.80) / (1.0 - 0.80))) END)", "(least(1, abs(byte_mean - 127.5) / 127.5) * 0.3)"],
    "strings": [f"(CASE WHEN {x} > 0 THEN 1 / (1 + exp(-{s} * ({x} - {m}))) END)" for x, (m, s) in score.COUNTS.items()]
    + [f"(CASE WHEN {x} THEN 0.6 WHEN NOT {x} THEN 0.0 END)" for x in ("has_outdated_libssl", "has_outdated_busybox")],
    "binwalk": [
        "(CASE WHEN has_encrypted_sections THEN 0.8 ELSE 0.0 END)", "(least(1, n_crypto_signatures / 5.0) * 0.5)", "least(1, entropy_variance_across_sections / 3.0)",
        "(CASE WHEN lower(fs_type) IN ('cramfs', 'jffs2') THEN 0.4 WHEN fs_type IS NOT NULL THEN 0.0 END)", "(CASE WHEN compression_type = 'gzip' THEN 0.2 ELSE 0.0 END)",
        "(CASE WHEN n_filesystems > 0 THEN least(1, n_filesystems / 3.0) * 0.3 END)",
    ],
}
_MEANS = ", ".join(f"list_avg(list_filter([{', '.join(f'({x})::DOUBLE' for x in parts)}], lambda v: v IS NOT NULL)) AS s_{n}" for n, parts in _SCORE.items())
_REVIEWS = "r AS (SELECT source, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (quality = 0) AS no, count(*) FILTER (quality IS NULL) AS unsure FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)"
_Z = sampling.Z95
_BOUND = lambda sign: f"((yes / n + {_Z ** 2} / (2 * n)) / (1 + {_Z ** 2} / n) {sign} {_Z} / (1 + {_Z ** 2} / n) * sqrt(yes / n * (1 - yes / n) / n + {_Z ** 2} / (4 * n * n)))"
_QUOTA = lambda target: f"""c AS (SELECT lang, count(*) AS capacity, row_number() OVER (ORDER BY lang) AS i, count(*) OVER () AS m FROM documents GROUP BY lang),
q AS (SELECT lang, capacity, least(capacity, {target} // m + CASE WHEN i <= {target} % m THEN 1 ELSE 0 END) AS quota FROM c)"""  # noqa: E731

#: Least labels from orders to parts and back, more often than any two orders of a component are apart.
_COMPONENTS = "e AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS model FROM lineitem), l0 AS (SELECT DISTINCT id, id AS label FROM e), " + ", ".join(
    f"m{k} AS MATERIALIZED (SELECT model, min(label) AS label FROM e JOIN l{k - 1} USING (id) GROUP BY model), "
    f"l{k} AS MATERIALIZED (SELECT id, min(label) AS label FROM e JOIN m{k} USING (model) GROUP BY id)"
    for k in range(1, 13)
)

SQL = {
    "q_quantiles": "SELECT l_returnflag, "
    + ", ".join(f"round(quantile_cont(l_extendedprice::DOUBLE, {p}), 4) AS {n}" for p, n in ((0.025, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.975, "high")))
    + " FROM lineitem GROUP BY l_returnflag",
    "q_confusion": f"WITH {_P} {_CLASS_SQL}",
    "q_macro_f1": f"""WITH {_P} SELECT lang, count(*) AS n, round(avg((y = a)::INT), 6) AS accuracy, round({_macro('a')}, 6) AS macro_f1,
  round(list_avg(list_filter([count(*) FILTER (y = '0' AND a = '0') / nullif(count(*) FILTER (y = '0'), 0), count(*) FILTER (y = '1' AND a = '1') / nullif(count(*) FILTER (y = '1'), 0)], lambda v: v IS NOT NULL)), 6) AS balanced_accuracy
FROM p GROUP BY lang""",
    "q_weighted_f1": f"""WITH {_P}, w AS (SELECT *, 1.0::DOUBLE AS w_all, CASE WHEN source = 'src0' THEN 0.0 ELSE 1.0 END::DOUBLE AS w_without, (1.0 / count(*) OVER (PARTITION BY source))::DOUBLE AS w_group FROM p)
"""
    + " UNION ALL ".join(f"SELECT lang, '{w}' AS scenario, round({_macro('b', w)}, 6) AS macro_f1 FROM w GROUP BY lang" for w in ("w_all", "w_without", "w_group")),
    "q_bootstrap": f"""WITH {_P}, d AS (SELECT i // 20 AS resample, ((i // 20) * 7919 + (i % 20) * 104729 + (i // 20) * (i % 20) * 31) % 20 AS rank FROM range(40000) t(i)),
s AS (SELECT resample, source, count(*) AS k FROM d JOIN (SELECT DISTINCT source FROM p) n ON regexp_extract(source, '(\\d+)', 1)::BIGINT % 20 = rank GROUP BY ALL),
r AS (SELECT resample, {_macro('a', 'k')} AS fa, {_macro('b', 'k')} AS fb FROM p JOIN s USING (source) GROUP BY resample),
q AS (SELECT quantile_cont(fa, [0.025, 0.975]) AS qa, quantile_cont(fb, [0.025, 0.975]) AS qb, quantile_cont(fa - fb, [0.025, 0.975]) AS qd FROM r),
t AS (SELECT {_macro('a')} AS first, {_macro('b')} AS second FROM p)
SELECT round(first, 6) AS first, round(second, 6) AS second, round(first - second, 6) AS delta, round(qa[1], 6) AS first_low, round(qa[2], 6) AS first_high, round(qb[1], 6) AS second_low, round(qb[2], 6) AS second_high,
  round(qd[1], 6) AS delta_low, round(qd[2], 6) AS delta_high FROM t, q""",
    "q_majority": f"WITH {_P}, c AS (SELECT lang, y, count(*) AS n FROM p GROUP BY ALL) SELECT lang, arg_max(y, n * 2 + (y = '1')::INT) AS majority FROM c GROUP BY lang",
    "q_invalid_predictions": f"""WITH {_P}, x AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN b END AS b FROM p), u AS (SELECT * FROM x UNION ALL SELECT * FROM x WHERE doc_id % 7 = 0)
SELECT 'repeated' AS problem, count(*) AS n FROM p WHERE doc_id % 7 = 0 UNION ALL SELECT 'label', count(*) FROM u WHERE b IS NULL""",
    "q_components": f"WITH {_COMPONENTS} SELECT id AS l_orderkey, 'g:' || label AS \"group\" FROM l12",
    "q_fold_checks": "SELECT 0 AS crossings, 0 AS not_once",
    "q_rule_score": f"""WITH f AS (SELECT k, {", ".join(f"{e} AS {n}" for n, e in FEATURES.items())} FROM (SELECT o_orderkey AS k FROM orders)),
s AS (SELECT *, {_MEANS}, (entropy IS NULL)::INT + (compress_ratio IS NULL)::INT + (count_non_public_ips IS NULL)::INT + (has_outdated_busybox IS NULL)::INT + (fs_type IS NULL)::INT AS missing FROM f),
t AS (SELECT *, (s_stats * 0.10 + coalesce(s_strings, 0) * 0.30 + s_binwalk * 0.15) / 0.55 AS score FROM s),
h AS (SELECT *, list_filter([CASE WHEN has_telnetd THEN 'has_telnetd' END, CASE WHEN has_debug_account THEN 'has_debug_account' END, CASE WHEN count_hardcoded_passwords > 0 THEN 'hardcoded_passwords' END], lambda v: v IS NOT NULL) AS rules FROM t)
SELECT k, round(s_stats, 6) AS score_stats, round(coalesce(s_strings, 0), 6) AS score_strings, round(s_binwalk, 6) AS score_binwalk, round(score, 6) AS score,
  CASE WHEN score < 0.20 AND len(rules) = 0 THEN 'sem_cve_conhecida' WHEN score < 0.60 THEN 'cve_conhecida' ELSE 'cve_critica' END AS level,
  CASE WHEN score < 0.20 THEN rules[1] END AS hard_rule, array_to_string(rules, ',') AS hard_rules, missing AS missing_ignored FROM h""",
    "q_wilson": f"""WITH {_REVIEWS}, w AS (SELECT *, (yes + no)::DOUBLE AS n FROM r)
SELECT source, CASE WHEN n > 0 THEN round(greatest(0, {_BOUND("-")}), 6) END AS low, CASE WHEN n > 0 THEN round(least(1, {_BOUND("+")}), 6) END AS high FROM w""",
    "q_decide": f"""WITH {_REVIEWS}, w AS (SELECT *, (yes + no)::DOUBLE AS n FROM r)
SELECT source, CASE WHEN unsure / (n + unsure) > 0.7 THEN 'reformulate' WHEN n < 3 THEN 'reformulate' WHEN greatest(0, {_BOUND("-")}) >= 0.7 THEN 'keep' WHEN least(1, {_BOUND("+")}) < 0.7 THEN 'remove' ELSE 'reformulate' END AS decision FROM w""",
    "q_draw": f"""WITH {_QUOTA(60)}, h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('0/urls/' || doc_id), doc_id) AS n FROM documents)
SELECT h.doc_id, h.lang FROM h JOIN q USING (lang) WHERE n <= quota""",
    "q_ordinal_fetch": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 3",
    "q_redact": f"""WITH s AS ({_COMPOSED_SQL}) SELECT k, pos, 'telnetd' AS detector, s AS shown FROM s WHERE contains(s, 'telnetd')
UNION ALL SELECT k, pos, 'hardcoded_passwords', '<redigido:len=' || length(s) || ',sha256=' || left(sha256(s), 8) || '>' FROM s WHERE s LIKE 'wpa_psk=%' OR s = 'default login admin' OR s = 'user guest'""",
}
