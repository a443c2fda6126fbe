"""Prevalence and coverage tables over groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import joined, quantiles


def _unpivot(df: DataFrame, keys: list[str], columns: list[str], kind: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast(kind).alias("value")) for x in columns])
    return df.select(*keys, F.inline(entries))


def prevalence(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(column, group, n, n_missing, n_present, ratio) for all rows (group null) and
    each group. Nulls aren't in the denominator; without one the ratio is NaN.
    """
    long = _unpivot(df, [group], columns, "double")
    counts = long.groupingSets([["column"], ["column", group]], "column", group).agg(
        F.grouping(group).alias("all"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.count_if(F.col("value") > 0).alias("n_present"),
    )
    valid = F.col("n") - F.col("n_missing")
    ratio = F.when(valid == 0, F.lit(float("nan"))).otherwise(F.try_divide("n_present", valid))
    return counts.select("column", F.when(F.col("all") == 1, F.lit("*")).otherwise(F.col(group)).alias(group), "n", "n_missing", "n_present", ratio.alias("ratio"))


def coverage(df: DataFrame, keys: list[str], within: str, columns: list[str], small: int = 5) -> DataFrame:
    """(keys, within, column, n, missing, q1, median, q3, mean, is_small) for each
    group of keys, in all ("*") and in each value of within. Quartiles are exact,
    and no group is in one task.
    """
    long = _unpivot(df, [*keys, within], columns, "double")
    by, fine = ["column", *keys], ["column", *keys, within]
    told = long.groupingSets([by, fine], *fine).agg(
        F.grouping(within).alias("all"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean")
    )
    counts = long.groupBy(*fine, "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupingSets([[*by, "value"], [*fine, "value"]], *fine, "value").agg(F.grouping(within).alias("all"), F.sum("n").alias("n"))
    q = quantiles(counts, [*fine, "all"], "value", "n", [0.25, 0.5, 0.75])
    out = joined(told, q, [*fine, "all"], "left")
    return out.select(
        *keys,
        F.when(F.col("all") == 1, F.lit("*")).otherwise(F.col(within)).alias(within),
        "column",
        "n",
        "missing",
        F.get("q", 0).alias("q1"),
        F.get("q", 1).alias("median"),
        F.get("q", 2).alias("q3"),
        "mean",
        (F.col("n") < small).alias("is_small"),
    )
