"""Permutation importance of a forest, over all folds of a run at once."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.storage import checkpointed, numbered
from .extra_trees import parts_of, predicted, score_rows
from .metrics import confusion, macro_metrics

FOLD = ["repeat", "fold"]
#: Rows of a fold of which a task deals a column whole.
DEALT = 1 << 20


def permutations(rows: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """(repeat, fold, key, column, draw, value): for each draw of each column its values dealt
    anew among the rows of the fold.

    A row takes the value at its own place in the order of hashes of seed, draw, column and
    key.
    """
    return dealt(rows, key, draws, seed).select(*FOLD, key, "column", F.posexplode("values").alias("draw", "value"))


def dealt(rows: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """permutations with a row for each column: repeat, fold, key, column, values by draw. A
    column of a fold of at most DEALT rows is dealt in a task.
    """
    sizes = checkpointed(rows.groupBy(*FOLD).agg(F.count(F.lit(1)).alias("n")))
    cells = rows.select(*FOLD, key, F.posexplode("x").alias("column", "value"))
    hashed = lambda d: F.xxhash64(F.lit(seed), *[F.col(c) for c in (*FOLD, "column")], F.lit(d), F.col(key))
    few = cells.join(sizes.where(F.col("n") <= DEALT).drop("n"), FOLD).withColumn("hashes", F.array(*[hashed(d) for d in range(draws)]))
    by = [*FOLD, "column"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.select(*by, key).schema) + ", values array<double>"
    schema = to_arrow_schema(T.StructType.fromDDL(types))

    def told(values: tuple, parts: list[pa.RecordBatch]):
        part = pa.Table.from_batches(parts).combine_chunks()
        hashes = part.column("hashes").combine_chunks().flatten().to_numpy().reshape(-1, draws)
        value = part.column("value").combine_chunks()
        places = pa.array(np.argsort(hashes, axis=0, kind="stable").ravel())  # of equal hashes, rows are in the order of keys
        for i in range(0, len(part), 10_000):
            some = places[i * draws : (i + 10_000) * draws]
            n = len(some) // draws
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * draws, pa.int32()), value.take(some))
            columns = [*[pa.array([v] * n, schema.field(c).type) for c, v in zip(by, values, strict=True)], part.column(key).combine_chunks()[i : i + n], lists]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).cast(schema)

    def run(batches):
        now, parts = None, []
        for batch in batches:
            values, start = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in by], 0
            for group, some in groupby(zip(*values, strict=True)):
                n = len(list(some))
                if group != now and parts:
                    yield from told(now, parts)
                    parts = []
                now = group
                parts.append(batch.slice(start, n))
                start += n
        if parts:
            yield from told(now, parts)

    out = few.repartition(*by).sortWithinPartitions(*by, key).mapInArrow(run, types)
    if sizes.where(F.col("n") > DEALT).isEmpty():
        return out
    many = _by_ranges(rows.join(sizes.where(F.col("n") > DEALT).drop("n"), FOLD), key, draws, seed)
    values = F.transform(F.array_sort(F.collect_list(F.struct("draw", "value"))), lambda v: v["value"])
    return out.unionByName(many.groupBy(*FOLD, key, "column").agg(values.alias("values")))


def _by_ranges(rows: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """permutations where no fold or column is sorted in one task: both orders are over all
    folds, columns and draws together, in ranges that are sorted apart. They have the same
    borders, so values stay in their fold.
    """
    cells = rows.select(*FOLD, key, F.posexplode("x").alias("column", "value")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    cells = checkpointed(cells.withColumn("__hash", F.xxhash64(F.lit(seed), *[F.col(c) for c in (*FOLD, "column", "draw", key)])))
    mine = numbered(cells.drop("value", "__hash"), [*FOLD, "column", "draw", key], "__place")
    placed = numbered(cells, [*FOLD, "column", "draw", "__hash", key], "__place").select("__place", "value")
    return mine.join(placed, "__place").drop("__place")


def check_reproduced(scored: DataFrame, predictions: DataFrame, key: str) -> None:
    """An error that names a fold whose model doesn't give the stored predictions, or has none."""
    stored = predictions.select(*FOLD, key, F.col("y_pred").alias("stored"))
    odd = stored.join(scored.select(*FOLD, key, "y_pred"), [*FOLD, key], "full").where(~F.col("stored").eqNullSafe(F.col("y_pred")))
    found = odd.groupBy(*FOLD).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_pred").isNull()).alias("without")).orderBy(*FOLD).first()
    if found:
        what = "has no model" if found["n"] == found["without"] else "has a model that doesn't give its stored predictions"
        raise ValueError(f"fold {found['fold']} of repeat {found['repeat']} {what} ({found['n']} rows)")


def permutation_importance(
    model: DataFrame, predictions: DataFrame, df: DataFrame, folds: DataFrame, key: str, features: list[str], label: str, classes: list[str],
    draws: int = 10, seed: int = 0, confidence: float = 0.95, kind: str = "extra_trees", purpose: str = "reported",
) -> DataFrame:
    """One row for each feature: mean_drop of the macro-F1 of the test parts when its values
    are dealt anew, std_drop over folds, ci_low and ci_high (linear quantiles over folds),
    n_folds and drops (array<struct<repeat, fold, drop>> in that order).

    model, folds and predictions are those of a run of extremely randomised trees, each key
    once in a test part; another kind or purpose is an error, as is a fold whose model
    doesn't give its stored predictions. A missing value is dealt like any other. All
    copies of a row with one changed value are scored in one pass over the forests.
    """
    if kind != "extra_trees" or purpose != "reported":
        raise ValueError(f"importance is of the reported extremely randomised trees, not of {kind} ({purpose})")
    tested = checkpointed(parts_of(df, folds, key, features, label, classes).where("role = 'test'"))
    changed = F.transform("values", lambda v, d: F.struct(F.col("column"), d.alias("draw"), v.alias("value")))
    copies = dealt(tested, key, draws, seed).select(*FOLD, key, changed.alias("some")).groupBy(*FOLD, key).agg(F.flatten(F.collect_list("some")).alias("copies"))
    rows = tested.select(*FOLD, key, "x").join(copies, [*FOLD, key])
    told = checkpointed(predicted(score_rows(model, rows, FOLD, key, len(classes), only_class=True), classes).select(*FOLD, key, "y_pred", "copies"))
    check_reproduced(told, predictions, key)

    judged = told.join(tested.select(*FOLD, key, "y_true"), [*FOLD, key])
    none = F.lit(None).cast("int")
    itself = judged.select(*FOLD, none.alias("column"), none.alias("draw"), "y_true", "y_pred")
    named = F.array(*[F.lit(c) for c in classes])
    judged = itself.unionByName(judged.select(*FOLD, "y_true", F.inline("copies")).withColumn("y_pred", F.get(named, F.col("class"))).drop("class"))
    by = [*FOLD, "column", "draw"]
    f1 = macro_metrics(confusion(judged, by, "y_true", "y_pred", classes), by, classes).select(*by, "macro_f1")
    base = f1.where("column IS NULL").select(*FOLD, F.col("macro_f1").alias("base"))
    each = F.struct("draw", (F.col("base") - F.col("macro_f1")).alias("drop"))
    mean = lambda items, value: F.aggregate(F.array_sort(items), F.lit(0.0), lambda t, s: t + s[value]) / F.size(items)
    drops = f1.where("column IS NOT NULL").join(base, FOLD).groupBy(*FOLD, "column").agg(F.collect_list(each).alias("each"))
    drops = drops.select(*FOLD, "column", mean(F.col("each"), "drop").alias("drop"))
    tail = (1 - confidence) / 2
    out = drops.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct(*FOLD, "drop"))).alias("drops"), F.percentile("drop", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"), F.count(F.lit(1)).alias("n_folds")
    )
    out = out.withColumn("mean_drop", mean(F.col("drops"), "drop"))
    spread = F.aggregate("drops", F.lit(0.0), lambda t, s: t + (s["drop"] - F.col("mean_drop")) * (s["drop"] - F.col("mean_drop")))
    names = F.array(*[F.lit(c) for c in features])
    return out.select(
        F.get(names, F.col("column")).alias("feature"), "mean_drop", F.when(F.col("n_folds") > 1, F.sqrt(spread / (F.col("n_folds") - 1))).alias("std_drop"),
        F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "n_folds", "drops",
    )
