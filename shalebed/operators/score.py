"""The weighted rule score with hard rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contract as c

# Fixed values of the score.
WEIGHTS = {"stats": 0.10, "strings": 0.30, "binwalk": 0.15}
LOW, HIGH = 0.20, 0.60
COUNTS = {
    "count_hardcoded_passwords": (1.0, 2.0),
    "count_credential_pairs": (1.0, 3.0),
    "count_non_public_ips": (2.0, 1.0),
    "count_public_ips": (1.0, 2.5),
}
OUTDATED = ["has_outdated_libssl", "has_outdated_busybox", "has_outdated_dropbear"]
OUTDATED_SCORE, ENCRYPTED_SCORE, FS_SCORE, COMPRESSION_SCORE = 0.6, 0.8, 0.4, 0.2
LEGACY_FS, LEGACY_COMPRESSION = ["cramfs", "jffs2"], ["gzip"]
HARD_RULES = {"has_telnetd": c.KNOWN, "has_debug_account": c.KNOWN, "hardcoded_passwords": c.KNOWN}


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _sigmoid(x: Column, midpoint: float, steepness: float) -> Column:
    exponent = -steepness * (x - midpoint)
    return F.when(exponent > 700, 0.0).otherwise(1.0 / (1.0 + F.exp(exponent)))


def rule_score(df: DataFrame) -> DataFrame:
    """df with score_stats, score_strings, score_binwalk, missing_ignored, score,
    level, hard_rule and hard_rules. Columns that df lacks take no part; nulls are
    ignored and counted.
    """
    has = set(df.columns)
    col = lambda name: F.col(name) if name in has else F.lit(None).cast("double")
    flag = lambda name: col(name).cast("boolean")
    given = lambda name, value: F.when(col(name).isNotNull(), value)

    groups = {
        "stats": (
            ["entropy", "compress_ratio", "byte_mean"],
            [
                given("entropy", _clamp((col("entropy") - 6.0) / 2.0)),
                given("compress_ratio", _clamp((col("compress_ratio") - 0.80) / (1.0 - 0.80))),
                given("byte_mean", _clamp(F.abs(col("byte_mean") - 127.5) / 127.5) * 0.3),
            ],
        ),
        "strings": (
            [*COUNTS, *OUTDATED],
            [F.when(col(x) > 0, _sigmoid(col(x).cast("double"), m, s)) for x, (m, s) in COUNTS.items()]
            + [given(x, F.when(flag(x), OUTDATED_SCORE).otherwise(0.0)) for x in OUTDATED],
        ),
        "binwalk": (
            ["has_encrypted_sections", "n_crypto_signatures", "entropy_variance_across_sections", "fs_type", "compression_type", "n_filesystems"],
            [
                given("has_encrypted_sections", F.when(flag("has_encrypted_sections"), ENCRYPTED_SCORE).otherwise(0.0)),
                given("n_crypto_signatures", F.least(F.lit(1.0), col("n_crypto_signatures") / 5.0) * 0.5),
                given("entropy_variance_across_sections", F.least(F.lit(1.0), col("entropy_variance_across_sections") / 3.0)),
                given("fs_type", F.when(F.lower(col("fs_type").cast("string")).isin(*LEGACY_FS), FS_SCORE).otherwise(0.0)),
                given("compression_type", F.when(F.lower(col("compression_type").cast("string")).isin(*LEGACY_COMPRESSION), COMPRESSION_SCORE).otherwise(0.0)),
                F.when(col("n_filesystems") > 0, F.least(F.lit(1.0), col("n_filesystems") / 3.0) * 0.3),
            ],
        ),
    }
    out, missing = df, F.lit(0)
    for name, (columns, parts) in groups.items():
        valued = F.size(F.filter(F.array(*[col(x).isNotNull() for x in columns]), lambda x: x))
        present = valued > 0
        if name == "binwalk":
            only_count = (valued == 1) & F.coalesce(col("n_filesystems") <= 0, F.lit(False))
            present = present & ~only_count
        kept = F.filter(F.array(*[p.cast("double") for p in parts]), lambda x: x.isNotNull())
        mean = F.coalesce(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda t, x: t + x), F.size(kept)), F.lit(0.0))
        out = out.withColumn(f"score_{name}", F.when(present, mean))
        missing = missing + F.size(F.filter(F.array(*[col(x).isNull() if x in has else F.lit(False) for x in columns]), lambda x: x))
    weight = sum((F.when(F.col(f"score_{n}").isNotNull(), w).otherwise(0.0) for n, w in WEIGHTS.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(f"score_{n}") * w, F.lit(0.0)) for n, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("missing_ignored", missing).withColumn("__w", weight).withColumn("score", F.coalesce(F.try_divide(total, F.col("__w")), F.lit(0.0)))
    level = (
        F.when(F.col("__w") == 0, c.NO_KNOWN).when(F.col("score") < LOW, c.NO_KNOWN).when(F.col("score") < HIGH, c.KNOWN).otherwise(c.CRITICAL)
    )
    active = {
        "has_telnetd": F.coalesce(flag("has_telnetd"), F.lit(False)),
        "has_debug_account": F.coalesce(flag("has_debug_account"), F.lit(False)),
        "hardcoded_passwords": F.coalesce(col("count_hardcoded_passwords") > 0, F.lit(False)),
    }
    fired = F.filter(F.array(*[F.when(a, F.lit(n)) for n, a in active.items()]), lambda x: x.isNotNull())
    out = out.withColumn("__level", level).withColumn("hard_rules", fired)
    # All rules raise to the same level, so the first that is active applies where the score is below it.
    raised = (F.size("hard_rules") > 0) & (F.col("__level") == c.NO_KNOWN)
    return out.withColumn("level", F.when(raised, c.KNOWN).otherwise(F.col("__level"))).withColumn(
        "hard_rule", F.when(raised, F.get("hard_rules", 0))
    ).drop("__w", "__level")
