"""Connected groups of ids and models, and leak-free folds over them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import checkpointed, numbered
from .quantiles import joined

PREFIX = "g:"


def connected_groups(links: DataFrame, key: str, model: str, max_rounds: int = 60) -> DataFrame:
    """(key, group): ids that share a model, directly or over others, are one
    group, named by its least id. links: (key, model).

    Each round an id gets the least label of its models and labels that share a model
    become the links of the next one: stars of the least label of each model, without
    repeats. So links are read whole in the first round only and get fewer each time.
    Labels go to the labels of their labels until none changes, so long chains need few rounds.
    """
    links = links.select(F.col(key).alias("id"), F.col(model).alias("model")).where("id IS NOT NULL AND model IS NOT NULL")
    found = []
    for _ in range(max_rounds):
        near = links.join(links.groupBy("model").agg(F.min("id").alias("label")), "model").groupBy("id").agg(F.min("label").alias("label"))
        near = checkpointed(near)
        found.append(_ends(near) if len(found) else near)
        moved = links.join(found[-1], "id").select("label", "model").distinct()
        # A model of one label joins nothing.
        least = moved.groupBy("model").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("model", "least")
        star = moved.join(least, "model").select(F.col("label").alias("id"), F.col("least").alias("model")).distinct()
        links = checkpointed(star)
        if links.isEmpty():
            break
    else:
        raise RuntimeError(f"groups aren't settled after {max_rounds} rounds")
    labels = found.pop()
    while found:
        # Labels that no model joins with others stay.
        further = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = found.pop().join(further, "label", "left").select("id", F.coalesce("further", "label").alias("label"))
    return labels.select(F.col("id").alias(key), F.concat(F.lit(PREFIX), F.col("label").cast("string")).alias("group"))


def _ends(labels: DataFrame) -> DataFrame:
    """(id, label) with the last label of the chain that begins at an id; a label is an id, and the
    last one its own.
    """
    while True:
        further = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        on = checkpointed(labels.join(further, "label").select("id", F.col("further").alias("label"), (F.col("label") != F.col("further")).alias("moved")))
        labels = on.drop("moved")
        if on.where("moved").isEmpty():
            return labels


def grouped_folds(table: DataFrame, key: str, group: str, label: str, n_folds: int, seed: int = 0, repeat: int = 0) -> DataFrame:
    """(repeat, seed, fold, key, role, group): each group is in the test part of one
    fold, folds have like shares of the classes.

    Groups of the same class counts are dealt evenly, by a hash of the seed; what is
    left of them, fewer than folds, goes from those whose classes vary most to the
    fold that each makes least uneven. The loop sees a row for each different vector
    of class counts, however many groups have it.
    """
    counts = table.groupBy(group).pivot(label).count().fillna(0)
    classes = [f"__class{i}" for i in range(len(counts.columns) - 1)]
    counts = counts.toDF(group, *classes).withColumn("__tie", F.xxhash64(F.lit(seed), F.col(group).cast("string")))
    placed = numbered(counts, [*classes, "__tie", group], "__place")
    vectors = placed.groupBy(*classes).agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__start")).collect()

    def spread(values: list[float]) -> float:
        mean = sum(values) / len(values)
        return sum((v - mean) ** 2 for v in values)

    totals = {x: sum(r[x] * r["__n"] for r in vectors) or 1 for x in classes}
    held = [{x: 0 for x in classes} for _ in range(n_folds)]
    dealt = []
    for row in sorted(vectors, key=lambda r: (-spread([r[x] for x in classes]), *(r[x] for x in classes))):
        def uneven(fold: int, row=row) -> tuple:
            shares = [
                spread([(held[f][x] + (row[x] if f == fold else 0)) / totals[x] for f in range(n_folds)]) for x in classes
            ]
            return sum(shares) / len(shares), sum(held[fold].values()), fold

        own, left = divmod(row["__n"], n_folds)
        got = [own] * n_folds
        for f in range(n_folds):
            for x in classes:
                held[f][x] += own * row[x]
        for _ in range(left):
            best = min(range(n_folds), key=uneven)
            got[best] += 1
            for x in classes:
                held[best][x] += row[x]
        dealt.append((*(row[x] for x in classes), [row["__start"] + n for n in accumulate(got)]))
    # A group's fold is the number of folds whose last place is before its own.
    ends = table.sparkSession.createDataFrame(dealt, ", ".join(f"{x} long" for x in classes) + ", __ends array<long>")
    fold_of = F.size(F.filter("__ends", lambda end: end <= F.col("__place"))).alias("test_fold")
    assigned = placed.join(F.broadcast(ends), classes).select(group, fold_of)
    folds = table.select(key, group).join(assigned, group).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    role = F.when(F.col("fold") == F.col("test_fold"), "test").otherwise("train")
    return folds.select(
        F.lit(repeat).cast("long").alias("repeat"), F.lit(seed).cast("long").alias("seed"), F.col("fold").cast("long").alias("fold"), key, role.alias("role"), group
    )


def crossings(folds: DataFrame, links: DataFrame, key: str, model: str) -> DataFrame:
    """(repeat, fold, what, value): ids and models in both roles of a fold."""
    with_models = folds.join(links.select(key, model).distinct(), key)
    both = lambda df, value: df.groupBy("repeat", "fold", F.col(value).cast("string").alias("value")).agg(
        F.count_distinct("role").alias("roles")
    ).where("roles > 1").select("repeat", "fold", F.lit(value).alias("what"), "value")
    return both(folds, key).unionByName(both(with_models, model))


def not_tested_once(folds: DataFrame, key: str) -> DataFrame:
    """(repeat, key, n): ids that aren't in the test part exactly once in a repeat."""
    return folds.groupBy("repeat", key).agg(F.count_if(F.col("role") == "test").alias("n")).where("n <> 1")


def fold_summary(folds: DataFrame, table: DataFrame, key: str, label: str, classes: list[str]) -> DataFrame:
    joined = folds.join(table.select(key, label), key)
    return joined.groupBy("repeat", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("group").alias("n_groups"), *[F.count_if(F.col(label) == x).alias(f"n_{x}") for x in classes]
    )


def with_group_size(df: DataFrame, group: str) -> DataFrame:
    """df with group_size; rows without a group are one."""
    return joined(df, df.groupBy(group).agg(F.count(F.lit(1)).alias("group_size")), [group])
