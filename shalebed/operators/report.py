"""Tables of a report: comparisons of arms, scenarios, exclusions, what classes lack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contract as c
from .metrics import class_metrics, confusion, paired_bootstrap, scenario_weights

# Fixed values of the tables.
NOT_BETTER, BETTER, UNCLEAR = "nulo_ou_negativo", "supera_b1", "inconclusivo"
WORSE, NOT_WORSE = "queda", "sem_queda_conclusiva"
APPLIES, NOT_APPLICABLE = "aplicável", "não aplicável"


def gain(delta: Column, low: Column) -> Column:
    """What a difference and the low end of its interval say of a gain."""
    return F.when(delta <= 0, NOT_BETTER).when(low > 0, BETTER).otherwise(UNCLEAR)


def loss(high: Column) -> Column:
    return F.when(high < 0, WORSE).otherwise(NOT_WORSE)


def _pairs(predictions: DataFrame, pairs: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """predictions, one column for each arm, as a row for each pair of arms."""
    rows = [F.struct(F.lit(a).alias("arm"), F.lit(b).alias("reference_arm"), F.col(a).alias("__first"), F.col(b).alias("__second")) for a, b in pairs]
    return predictions.select(*keep, F.inline(F.array(*rows)))


def comparison_table(
    predictions: DataFrame, resamples: DataFrame, group: str, true: str, arms: list[str], references: list[str], classes: list[str], anchor: tuple[str, str] | None = None
) -> DataFrame:
    """(arm, reference_arm, macro_f1, its ends, reference_macro_f1, delta, its ends,
    anchor, interpretation): every arm against every reference but itself, all over the
    same resamples and in one pass. Only the anchor pair is interpreted.
    """
    pairs = [(a, r) for r in references for a in arms if a != r]
    told = paired_bootstrap(_pairs(predictions, pairs, [group, true]), resamples, group, true, "__first", "__second", classes, keys=["arm", "reference_arm"])
    is_anchor = (F.col("arm") == anchor[0]) & (F.col("reference_arm") == anchor[1]) if anchor else F.lit(False)
    names = {"first": "macro_f1", "first_low": "macro_f1_low", "first_high": "macro_f1_high", "second": "reference_macro_f1"}
    return told.select(
        "arm", "reference_arm", *[F.col(a).alias(b) for a, b in names.items()], "delta", "delta_low", "delta_high",
        is_anchor.alias("anchor"), F.when(is_anchor, gain(F.col("delta"), F.col("delta_low"))).otherwise("").alias("interpretation"),
    )


def ablation_table(predictions: DataFrame, resamples: DataFrame, group: str, true: str, removed: dict[str, list[str]], reference: str, classes: list[str]) -> DataFrame:
    """comparison_table of the arms that lack columns against the one with all, with
    the columns each lacks and whether it is worse.
    """
    table = comparison_table(predictions, resamples, group, true, list(removed), [reference], classes)
    columns = F.when(F.lit(False), "")
    for arm, lacking in removed.items():
        columns = columns.when(F.col("arm") == arm, ";".join(lacking))
    return table.drop("anchor").withColumns({"removed_columns": columns, "interpretation": loss(F.col("delta_high"))})


def scenario_table(predictions: DataFrame, resamples: DataFrame, group: str, true: str, first: str, second: str, vendor: str, dropped: str, classes: list[str]) -> DataFrame:
    """(scenario, n, n_groups, the comparison, status): all rows alike, without a
    vendor, and each group as one. Without rows of that vendor its scenario doesn't
    apply and has no figures.
    """
    weights = {"w_all": "all", "w_without": "without_vendor", "w_group": "group_as_one"}
    rows = [F.struct(F.lit(name).alias("scenario"), F.col(w).alias("weight")) for w, name in weights.items()]
    long = scenario_weights(predictions, vendor, dropped, group).select(group, true, first, second, vendor, F.inline(F.array(*rows)))
    kept = F.col("weight") > 0
    sizes = long.groupBy("scenario").agg(
        F.count_if(kept).alias("n"), F.count_distinct(F.when(kept, F.col(group))).alias("n_groups"), F.bool_or(F.col(vendor) == dropped).alias("__any")
    )
    told = paired_bootstrap(long, resamples, group, true, first, second, classes, weight="weight", keys=["scenario"]).join(sizes, "scenario")
    applies = (F.col("scenario") != "without_vendor") | F.coalesce(F.col("__any"), F.lit(False))
    figures = [x for x in told.columns if x not in ("scenario", "__any")]
    return told.select("scenario", *[F.when(applies, F.col(x)).alias(x) for x in figures], F.when(applies, APPLIES).otherwise(NOT_APPLICABLE).alias("status"))


def delta_rows(parts: list[tuple[DataFrame, Column]]) -> DataFrame:
    """(label, delta, delta_low, delta_high) of tables with these columns; rows without a delta go."""
    shown = [df.select(label.alias("label"), "delta", "delta_low", "delta_high") for df, label in parts]
    return reduce(lambda a, b: a.unionByName(b), shown).na.drop(subset=["delta"])


def exclusion_table(ids: DataFrame) -> DataFrame:
    """One row for each vendor of ids (vendor, reasons): how many of them each reason
    excludes, all ids and the share of the undecided. Null reasons are none.
    """
    share = F.coalesce(F.try_divide(F.col("indeterminado").cast("double"), F.col("total_ids").cast("double")), F.lit(0.0))
    counts = [F.count_if(F.array_contains("reasons", r)).alias(r) for r in c.REASONS]
    return ids.groupBy("vendor").agg(*counts, F.count(F.lit(1)).alias("total_ids")).withColumn("proporcao_indeterminado", share)


def missing_classes(df: DataFrame, keys: list[str], label: str, classes: list[str]) -> DataFrame:
    """(keys, missing array): folds, vendors or others without some of the classes."""
    seen = df.groupBy(*keys).agg(F.collect_set(F.when(F.col(label).isin(*classes), F.col(label))).alias("__seen"))
    lacking = F.array_except(F.array(*[F.lit(x) for x in classes]), "__seen")
    return seen.select(*keys, lacking.alias("missing")).where(F.size("missing") > 0)


def one_hot(predicted: Column, classes: list[str]) -> list[Column]:
    """proba__class, 1.0 for the predicted class; a null prediction has 0.0 for all."""
    return [F.when(predicted == x, 1.0).otherwise(0.0).alias(f"proba__{x}") for x in classes]


def importance_table(drops: DataFrame, keys: list[str] | None = None, confidence: float = 0.95) -> DataFrame:
    """(feature, mean_drop, std_drop, ci_low, ci_high, n_folds) of drops (feature, fold,
    drop), the largest first, equals by name.
    """
    tail = (1 - confidence) / 2
    ends = F.percentile("drop", F.array(F.lit(tail), F.lit(1 - tail)))
    told = drops.groupBy(*(keys or []), "feature").agg(
        F.avg("drop").alias("mean_drop"), F.stddev_samp("drop").alias("std_drop"), F.get(ends, 0).alias("ci_low"), F.get(ends, 1).alias("ci_high"), F.count("drop").alias("n_folds")
    )
    return told.orderBy(F.desc("mean_drop"), "feature")


def in_order(df: DataFrame, column: str, names: list[str], *then: str) -> DataFrame:
    """Rows in the order of given names, others last, then by other columns."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    return df.orderBy(F.coalesce(F.nullif(place, F.lit(0)), F.lit(len(names) + 1)), *then)


def distribution(df: DataFrame, column: str, names: list[str | None]) -> DataFrame:
    """(column, n) for each of the given values, in this order and zero where there are
    none; None stands for null. Other values aren't told.
    """
    given = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], f"__i int, `{column}` string")
    counts = df.groupBy(F.col(column).cast("string").alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    joined = given.join(counts, given[column].eqNullSafe(counts["__v"]), "left").orderBy("__i")
    return joined.select(column, F.coalesce("n", F.lit(0)).alias("n"))


def alias_counts(aliases: DataFrame, key: str, model: str, differ: str) -> DataFrame:
    """One row: ids with several aliases, with several models (trimmed, any case) and
    with versions that differ; aliases has a row for each alias.
    """
    name = F.lower(F.trim(F.col(model)))
    ids = aliases.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(name).alias("models"), F.bool_or(differ).alias("differ"))
    return ids.agg(F.count_if(F.col("n") > 1).alias("several_aliases"), F.count_if(F.col("models") > 1).alias("several_models"), F.count_if("differ").alias("differing_versions"))


def by_first_row(df: DataFrame, key: str, row: str) -> DataFrame:
    """(key, first_row): ids in the order in which they first appear."""
    return df.groupBy(key).agg(F.min(row).alias("first_row")).orderBy("first_row", key)


def vendor_table(predictions: DataFrame, vendor: str, group: str, true: str, arms: list[str], classes: list[str]) -> DataFrame:
    """(vendor, arm, true_class, support, n_components, precision, recall, f1, undefined,
    pred__class): a row for each vendor, arm (a column of predictions) and class, also
    where a vendor has none of it. undefined names precision and recall without a
    denominator, joined by semicolons; n_components counts the groups of the class.
    """
    keys = [vendor, "arm"]
    told = predictions.select(vendor, true, F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("__told")) for a in arms])))
    matrix = confusion(told, keys, true, "__told", classes)
    rows = [F.struct(F.lit(c).alias("class"), *[F.col(f"m_{i}_{j}").alias(f"pred__{d}") for j, d in enumerate(classes)]) for i, c in enumerate(classes)]
    counted = predictions.groupBy(vendor, F.col(true).alias("class")).agg(F.count_distinct(group).alias("n_components"))
    by = class_metrics(matrix, keys, classes).join(matrix.select(*keys, F.inline(F.array(*rows))), [*keys, "class"]).join(counted, [vendor, "class"], "left")
    undefined = F.array_join(F.filter("undefined", lambda x: x != "f1"), ";").alias("undefined")
    return by.select(
        vendor, "arm", F.col("class").alias("true_class"), "support", F.coalesce("n_components", F.lit(0)).alias("n_components"), "precision", "recall", "f1", undefined, *[f"pred__{c}" for c in classes]
    )
