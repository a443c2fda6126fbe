"""What must hold of tables before they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import contract as c
from .corpus import lookup_join, must_be_empty, repeated_keys, unmatched
from .groups import with_group_size


def table_issues(table: DataFrame, key: str, target: str, classes: list[str]) -> DataFrame:
    """(problem, detail): repeated keys, columns that mustn't be features (forbidden,
    demoted, text) and targets outside of the classes, nulls included.
    """
    rows = []
    for field in table.schema:
        n = field.name
        if n in (key, target):
            continue
        if n in c.FORBIDDEN or n in c.ONE_HOT_SOURCES or n.startswith(tuple(c.FORBIDDEN_PREFIXES)):
            rows.append(("forbidden", n))
        if n in c.DEMOTED:
            rows.append(("demoted", n))
        if isinstance(field.dataType, StringType):
            rows.append(("text", n))
    columns = table.sparkSession.createDataFrame(rows, "problem string, detail string")
    repeated = repeated_keys(table, [key]).select(F.lit("repeated").alias("problem"), F.col(key).cast("string").alias("detail"))
    odd = table.where(~F.coalesce(F.col(target).isin(*classes), F.lit(False))).select(F.lit("target").alias("problem"), F.col(target).cast("string").alias("detail"))
    return columns.unionByName(repeated).unionByName(odd.distinct())


def vendor_issues(aliases: DataFrame, key: str, vendor: str, ids: DataFrame | None = None) -> DataFrame:
    """(key, problem): ids with several vendors, with none (null), and those of ids
    without an alias.
    """
    seen = aliases.groupBy(key).agg(F.count_distinct(vendor).alias("__n"), F.bool_or(F.col(vendor).isNull()).alias("__null"))
    found = seen.select(key, F.when(F.col("__n") > 1, "several").when(F.col("__null"), "null").alias("problem")).where("problem IS NOT NULL")
    if ids is None:
        return found
    return found.unionByName(ids.select(key).distinct().join(aliases, key, "left_anti").withColumn("problem", F.lit("no alias")))


def vendor_of_id(aliases: DataFrame, key: str, vendor: str) -> DataFrame:
    """(key, vendor), one row for each id; several or no vendors are an error."""
    must_be_empty(vendor_issues(aliases, key, vendor), "ids without one vendor")
    return aliases.groupBy(key).agg(F.min(vendor).alias(vendor))


def input_issues(features: DataFrame, labels: DataFrame, key: str, columns: list[str], label_columns: list[str]) -> DataFrame:
    """(problem, side, detail): columns that are missing, null keys and keys that one
    side lacks.
    """
    sides = (("features", features, columns), ("labels", labels, label_columns))
    missing = [("missing column", side, x) for side, df, wanted in sides for x in sorted(set(wanted) - set(df.columns))]
    out = features.sparkSession.createDataFrame(missing, "problem string, side string, detail string")
    for side, df, _ in sides:
        out = out.unionByName(df.where(F.col(key).isNull()).limit(1).select(F.lit("null key").alias("problem"), F.lit(side).alias("side"), F.lit(key).alias("detail")))
    name = F.when(F.col("side") == "left", "features").otherwise("labels")
    alone = unmatched(features.where(F.col(key).isNotNull()), labels.where(F.col(key).isNotNull()), key)
    return out.unionByName(alone.select(F.lit("unmatched").alias("problem"), name.alias("side"), F.col(key).cast("string").alias("detail")))


def tested(folds: DataFrame, key: str) -> DataFrame:
    """(key, group) of the test rows; an id that is tested twice is an error."""
    rows = folds.where("role = 'test'").select(key, "group")
    must_be_empty(repeated_keys(rows, [key]), "ids tested more than once")
    return rows


def out_of_fold_frame(folds: DataFrame, provenance: DataFrame, key: str, vendor: str, excluded: str, known: list[str] | None = None) -> DataFrame:
    """(key, group, group_size, vendor, has_excluded): component, its size and the
    vendor of each tested id. Ids without exactly one vendor are an error, and so is an
    excluded vendor that neither the provenance nor known has.
    """
    if excluded not in (known or []) and provenance.where(F.col(vendor) == excluded).isEmpty():
        raise ValueError(f"vendor {excluded} isn't in the provenance")
    frame = with_group_size(tested(folds, key), "group")
    told = lookup_join(frame, vendor_of_id(provenance, key, vendor), key)
    return told.select(key, "group", "group_size", vendor, (F.col(vendor) == excluded).alias("has_excluded"))


def encoded(df: DataFrame, column: str, dimension: DataFrame, index: str) -> DataFrame:
    """df with the index of a column's values in a dimension; unknown values are an error."""
    return lookup_join(df, dimension.select(column, index), column)
