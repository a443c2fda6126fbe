"""Labels from vulnerabilities, decided only where both bounds agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contract as c
from ..functions.versions import severity_bucket

SEVERITIES = ["critical", "high", "medium", "low"]


def score_stats(cves: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, cvss_max, cve_count_*, cve_total) of (key, score, severity). Other
    severities count in the total only; keys without a row get zeros.
    """
    bucket = severity_bucket(F.col("severity"))
    stats = cves.groupBy(key).agg(
        F.greatest(F.max("score"), F.lit(0.0)).alias("cvss_max"),
        *[F.count_if(bucket == s.upper()).alias(f"cve_count_{s}") for s in SEVERITIES],
        F.count(F.lit(1)).alias("cve_total"),
    )
    if keys is None:
        return stats
    filled = keys.select(key).distinct().join(stats, key, "left")
    return filled.select(key, *[F.coalesce(x, F.lit(0)).alias(x) for x in stats.columns if x != key])


def label_of(total: Column, score: Column, critical: float = 9.0) -> Column:
    return F.when(total == 0, F.lit(c.NO_KNOWN)).when(score >= critical, F.lit(c.CRITICAL)).otherwise(F.lit(c.KNOWN))


def merged_evidence(judged: DataFrame, key: str) -> DataFrame:
    """One row for each (key, cve_id) of (key, cve_id, score, verdict, nth): applicable
    in any alias removes undecided in others; the last alias gives the score.
    Those that apply to none and are undecided in none are left out.
    """
    kept = judged.where(F.col("verdict").isNull() | F.col("verdict"))
    return kept.groupBy(key, "cve_id").agg(
        F.bool_or(F.coalesce("verdict", F.lit(False))).alias("applicable"), F.max_by("score", "nth").alias("score")
    )


def bounded_labels(keys: DataFrame, judged: DataFrame, key: str, critical: float = 9.0) -> DataFrame:
    """(key, security_level, cve_total, cvss_max) of keys (key, not_found): the label
    if the lower bound (applicable only) and the upper (undecided too; critical
    where evidence wasn't found) agree, else undecided. Numbers are of the lower.
    """
    evidence = merged_evidence(judged, key)
    sums = evidence.groupBy(key).agg(
        F.count_if("applicable").alias("low_n"),
        F.max(F.when(F.col("applicable"), F.col("score"))).alias("low_max"),
        F.count(F.lit(1)).alias("high_n"),
        F.max("score").alias("high_max"),
    )
    sure = keys.groupBy(key).agg(F.bool_or("not_found").alias("not_found"))
    joined = sure.join(sums, key, "left").fillna(0, ["low_n", "high_n"]).fillna(0.0, ["low_max", "high_max"])
    low = label_of(F.col("low_n"), F.col("low_max"), critical)
    high = F.when(F.col("not_found"), F.lit(c.CRITICAL)).otherwise(label_of(F.col("high_n"), F.col("high_max"), critical))
    return joined.select(
        key,
        F.when(low == high, low).otherwise(F.lit(c.UNDECIDED)).alias("security_level"),
        F.col("low_n").alias("cve_total"),
        F.col("low_max").alias("cvss_max"),
        F.when(F.col("not_found"), F.lit(c.NOT_FOUND)).alias("evidence_reason"),
    )


def label_aliases(aliases: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The label of each alias's content, with strategy, alias_count and versions_differ.

    A missing version is a version of its own.
    """
    ids = aliases.groupBy(key).agg(F.count(F.lit(1)).alias("alias_count"), F.count("version").alias("__known"), F.coalesce(F.min("version") != F.max("version"), F.lit(False)).alias("__two"))
    differ = F.col("__two") | ((F.col("__known") > 0) & (F.col("__known") < F.col("alias_count")))
    strategy = F.when(F.col("alias_count") == 1, F.lit(c.SINGLE)).otherwise(F.lit(c.CONSERVATIVE))
    told = ids.select(key, "alias_count", differ.alias("versions_differ"), strategy.alias("label_strategy"))
    return aliases.join(told, key).join(labels, key)


def alias_evidence(judged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, applicable_cves, indeterminate_cves), sorted ids of each alias."""
    ids = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("cve_id"))))
    return judged.groupBy(*keys).agg(ids(F.col("verdict")).alias("applicable_cves"), ids(F.col("verdict").isNull()).alias("indeterminate_cves"))
