"""Out-of-fold models: forests with class weights, and baselines."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import numbered
from .metrics import majority_class


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """df with weight, n / (classes * n of the row's class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    weights = counts.crossJoin(total).select(label, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


def fit_forest(train: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 8, seed: int = 0):
    """Median imputation, removal of constant columns and a forest, fitted on train
    only. label: a number for each class. Constant columns only are an error.
    """
    if not any(train.agg(*[F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(c) for c in features]).first()):
        raise ValueError("every column is constant")
    numbers = train.withColumns({c: F.col(c).cast("double") for c in features})
    filled = [f"{c}__filled" for c in features]
    steps = [
        Imputer(inputCols=features, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="__all"),
        VarianceThresholdSelector(featuresCol="__all", outputCol="__features", varianceThreshold=0.0),
        RandomForestClassifier(featuresCol="__features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=steps).fit(balanced_weights(numbers, label))


def predict(model, df: DataFrame, features: list[str], classes: list[str]) -> DataFrame:
    """df with y_pred and proba__class; classes that training lacked get 0."""
    numbers = df.withColumns({c: F.col(c).cast("double") for c in features}).withColumn("weight", F.lit(1.0))
    out = model.transform(numbers).withColumn("__p", vector_to_array("probability"))
    names = F.array(*[F.lit(c) for c in classes])
    shown = {f"proba__{c}": F.coalesce(F.get("__p", i), F.lit(0.0)) for i, c in enumerate(classes)}
    return out.withColumns(shown | {"y_pred": F.get(names, F.col("prediction").cast("int"))}).select(*df.columns, "y_pred", *shown)


def out_of_fold(df: DataFrame, folds: DataFrame, key: str, features: list[str], label: str, classes: list[str], **forest) -> DataFrame:
    """(repeat, fold, key, y_true, y_pred, proba__*): each id predicted by the model
    of the fold that tests it. The loop is over folds, a few.
    """
    ids = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    numbered = df.withColumn("__y", ids.cast("double"))
    out = None
    for repeat, fold in sorted(tuple(r) for r in folds.select("repeat", "fold").distinct().collect()):
        mine = folds.where((F.col("repeat") == repeat) & (F.col("fold") == fold)).select(key, "role")
        parts = numbered.join(mine, key)
        model = fit_forest(parts.where("role = 'train'"), features, "__y", **forest)
        told = predict(model, parts.where("role = 'test'"), features, classes).select(
            F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), key, F.col(label).alias("y_true"), "y_pred", *[f"proba__{c}" for c in classes]
        )
        out = told if out is None else out.unionByName(told)
    return out


def majority_baseline(df: DataFrame, folds: DataFrame, key: str, label: str, classes: list[str]) -> DataFrame:
    """(repeat, fold, key, y_true, y_pred): the most frequent class of each fold's training part."""
    parts = folds.select("repeat", "fold", key, "role").join(df.select(key, label), key)
    major = majority_class(parts.where("role = 'train'"), ["repeat", "fold"], label, classes)
    return parts.where("role = 'test'").join(major, ["repeat", "fold"]).select("repeat", "fold", key, F.col(label).alias("y_true"), F.col("majority").alias("y_pred"))


def permuted(df: DataFrame, within: list[str], column: str, seed: int) -> DataFrame:
    """df with a column's values dealt anew among the rows of a fold, by hashes of the seed.
    Both orders are sorted in ranges over all folds, so no fold is in one task.
    """
    rows = df.withColumn("__order", F.struct(*df.columns)).withColumn("__hash", F.xxhash64(F.lit(seed), "__order"))
    ranked = numbered(rows, [*within, "__order"], "__at")
    dealt = numbered(rows, [*within, "__hash", "__order"], "__at").select("__at", F.col(column).alias("__value"))
    return ranked.join(dealt, "__at").withColumn(column, F.col("__value")).select(df.columns)
