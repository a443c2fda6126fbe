"""Confusion-based metrics and the paired group bootstrap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import numbered


def confusion(predictions: DataFrame, keys: list[str], true: str, predicted: str, classes: list[str], weight: Column | None = None) -> DataFrame:
    """One row for each keys with m_i_j, the weight of class i predicted as j."""
    w = F.lit(1) if weight is None else weight
    cells = [
        F.sum(F.when((F.col(true) == a) & (F.col(predicted) == b), w).otherwise(0)).alias(f"m_{i}_{j}")
        for i, a in enumerate(classes)
        for j, b in enumerate(classes)
    ]
    return predictions.groupBy(*keys).agg(*cells) if keys else predictions.agg(*cells)


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _cells(n: int) -> list[list[Column]]:
    return [[F.col(f"m_{i}_{j}") for j in range(n)] for i in range(n)]


def _f1(m: list[list[Column]], k: int) -> Column:
    row, column = _total(m[k]), _total([r[k] for r in m])
    return _ratio(2 * m[k][k], row + column)


def class_metrics(matrix: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """(keys, class, precision, recall, f1, support, undefined) of confusion rows.
    A ratio without a denominator is 0 and named in undefined.
    """
    m = _cells(len(classes))
    rows = []
    for k, name in enumerate(classes):
        row, column = _total(m[k]), _total([r[k] for r in m])
        undefined = F.filter(
            F.array(F.when(column == 0, F.lit("precision")), F.when(row == 0, F.lit("recall")), F.when(row + column == 0, F.lit("f1"))),
            lambda x: x.isNotNull(),
        )
        rows.append(
            F.struct(
                F.lit(name).alias("class"),
                _ratio(m[k][k], column).alias("precision"),
                _ratio(m[k][k], row).alias("recall"),
                _f1(m, k).alias("f1"),
                row.alias("support"),
                undefined.alias("undefined"),
            )
        )
    return matrix.select(*keys, F.inline(F.array(*rows)))


def macro_metrics(matrix: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """(keys, n, accuracy, macro_f1, balanced_accuracy); means over the fixed classes,
    balanced accuracy over those that occur.
    """
    m = _cells(len(classes))
    k = range(len(classes))
    n = _total([x for r in m for x in r])
    recalls = F.filter(F.array(*[F.when(_total(m[i]) > 0, _ratio(m[i][i], _total(m[i]))) for i in k]), lambda x: x.isNotNull())
    return matrix.select(
        *keys,
        n.alias("n"),
        _ratio(_total([m[i][i] for i in k]), n).alias("accuracy"),
        (_total([_f1(m, i) for i in k]) / len(classes)).alias("macro_f1"),
        _ratio(F.aggregate(recalls, F.lit(0.0), lambda t, x: t + x), F.size(recalls)).alias("balanced_accuracy"),
    )


def weighted_macro_f1(predictions: DataFrame, keys: list[str], true: str, predicted: str, classes: list[str], weight: Column) -> DataFrame:
    m = _cells(len(classes))
    f1 = _total([_f1(m, i) for i in range(len(classes))]) / len(classes)
    return confusion(predictions, keys, true, predicted, classes, weight).select(*keys, f1.alias("macro_f1"))


def invalid_predictions(predictions: DataFrame, keys: list[str], columns: list[str], classes: list[str]) -> DataFrame:
    """(problem, n): repeated keys and labels outside of the classes."""
    repeated = predictions.groupBy(*keys).count().where("count > 1").select(F.lit("repeated").alias("problem"))
    odd = predictions.where(reduce(lambda a, b: a | b, [~F.coalesce(F.col(x).isin(*classes), F.lit(False)) for x in columns])).select(F.lit("label").alias("problem"))
    return repeated.unionByName(odd).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def majority_class(df: DataFrame, keys: list[str], label: str, classes: list[str]) -> DataFrame:
    """The most frequent label of each keys; the earlier in classes of equals."""
    rank = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(label))
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("n"), -rank)).alias("majority"))


def draw_resamples(df: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """(resample, group, k): how often each group is drawn in n draws with
    replacement of as many groups. The same for every use, as it is a function of
    the seed: draw j of a resample is the group at a hashed rank.
    """
    ranked = numbered(df.select(group).distinct(), [group], "rank")
    total = ranked.count()
    draws = df.sparkSession.range(n * total).select(
        (F.col("id") / total).cast("long").alias("resample"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(total)).alias("rank")
    )
    return draws.groupBy("resample", "rank").agg(F.count(F.lit(1)).alias("k")).join(ranked, "rank").select("resample", group, "k")


def paired_bootstrap(
    predictions: DataFrame, resamples: DataFrame, group: str, true: str, first: str, second: str, classes: list[str],
    confidence: float = 0.95, weight: str | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """One row for each keys (one in all without): the macro-F1 of both arms and their
    difference, with intervals over the same resamples. predictions: a row has the
    label, both predictions and its group. The point estimates use the base weights only.

    Resamples meet sums by keys, group, label and predictions, not rows.
    """
    keys = keys or []
    base = F.lit(1.0) if weight is None else F.col(weight)
    cells = predictions.groupBy(*keys, group, true, first, second).agg(F.sum(base).alias("w"))
    drawn = cells.join(resamples, group).withColumn("w", F.col("w") * F.col("k"))
    arm = lambda df, by, column, name: weighted_macro_f1(df, by, true, column, classes, F.col("w")).withColumnRenamed("macro_f1", name)
    beside = lambda a, b: a.join(b, keys) if keys else a.crossJoin(b)
    both = arm(drawn, [*keys, "resample"], first, "a").join(arm(drawn, [*keys, "resample"], second, "b"), [*keys, "resample"])
    tail = (1 - confidence) / 2
    bounds = F.array(F.lit(tail), F.lit(1 - tail))
    spread = both.groupBy(*keys).agg(*[F.percentile(x, bounds).alias(n) for x, n in ((F.col("a"), "qa"), (F.col("b"), "qb"), (F.col("a") - F.col("b"), "qd"))])
    point = beside(beside(arm(cells, keys, first, "a"), arm(cells, keys, second, "b")), spread)
    ends = [F.get(q, i).alias(f"{n}_{e}") for q, n in (("qa", "first"), ("qb", "second"), ("qd", "delta")) for i, e in enumerate(("low", "high"))]
    return point.select(*keys, F.col("a").alias("first"), F.col("b").alias("second"), (F.col("a") - F.col("b")).alias("delta"), *ends)


def scenario_weights(df: DataFrame, vendor: str, dropped: str, group: str) -> DataFrame:
    """Row weights: all alike, without a vendor, and one for each group."""
    from .groups import with_group_size

    return with_group_size(df, group).withColumns(
        {"w_all": F.lit(1.0), "w_without": F.when(F.col(vendor) == dropped, 0.0).otherwise(1.0), "w_group": 1.0 / F.col("group_size")}
    )


def permutation_drops(scored: DataFrame, keys: list[str], base: str, permuted: str) -> DataFrame:
    """(keys, mean_drop, std_drop): how much a score falls, with the sample deviation."""
    return scored.groupBy(*keys).agg(F.avg(F.col(base) - F.col(permuted)).alias("mean_drop"), F.stddev_samp(F.col(base) - F.col(permuted)).alias("std_drop"))
