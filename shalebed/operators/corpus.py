"""Building a training table: reconciled ids, exclusions, collapsed aliases, one-hot columns.

Contract checks return the rows that break them; ``must_be_empty`` turns such a
table into an error that shows some.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import contract as c


def must_be_empty(violations: DataFrame, what: str, shown: int = 5) -> None:
    rows = violations.limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that one side lacks."""
    only = lambda a, b, side: a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def checked_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join that must be one to one; repeated keys on either side are an error."""
    for side, name in ((left, "left"), (right, "right")):
        must_be_empty(repeated_keys(side, [key]), f"repeated {key} on the {name}")
    return left.join(right, key, how)


def lookup_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A join in which every key of left must be found."""
    must_be_empty(left.select(key).distinct().join(right, key, "left_anti"), f"missing {key}")
    return left.join(right, key)


def state_violations(features: DataFrame, path: str = "meta_path") -> DataFrame:
    """(path, column, value, problem): transient states and unknown ones, null included."""
    parts = []
    for column, (keep, exclude, abort) in c.STATES.items():
        known = F.col(column).isin(*keep, *exclude, *abort)
        problem = F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown")).when(F.col(column).isin(*abort), F.lit("transient"))
        parts.append(F.struct(F.lit(column).alias("column"), F.col(column).alias("value"), problem.alias("problem")))
    return features.select(path, F.inline(F.array(*parts))).where("problem IS NOT NULL")


def exclusion_reasons(features: DataFrame, labels: DataFrame, key: str = "firmware_id") -> DataFrame:
    """(key, reasons array): all reasons of each excluded id, in their order."""
    failed = reduce(lambda a, b: a | b, [F.coalesce(F.col(s).isin(*x[1]), F.lit(False)) for s, x in c.STATES.items()])
    own = features.groupBy(key).agg(F.bool_or(failed).alias("f"), F.bool_or(F.col("meta_third_party").isNotNull()).alias("t"))
    unsure = labels.where(F.col("security_level") == c.UNDECIDED).select(key).distinct().withColumn("u", F.lit(True))
    flags = own.join(unsure, key, "full")
    named = F.filter(
        F.array(*[F.when(F.coalesce(F.col(f), F.lit(False)), F.lit(r)) for f, r in zip("ftu", c.REASONS)]), lambda r: r.isNotNull()
    )
    return flags.select(key, named.alias("reasons")).where(F.size("reasons") > 0)


def vendors_by_id(aliases: DataFrame, key: str, vendor: str) -> DataFrame:
    return aliases.groupBy(key).agg(F.array_sort(F.collect_set(vendor)).alias("vendors"))


def exclusion_report(reasons: DataFrame, vendors: DataFrame, key: str) -> DataFrame:
    """(vendor, reason, n): ids by reason, by vendor and by both; null stands for
    all. An id of two vendors counts once for each, and once in all.
    """
    joined = reasons.join(vendors, key)
    spread = joined.select(key, F.explode("vendors").alias("vendor"), "reasons")
    by_reason = joined.select(F.lit(None).cast("string").alias("vendor"), F.explode("reasons").alias("reason"))
    by_vendor = spread.select("vendor", F.lit(None).cast("string").alias("reason"))
    by_both = spread.select("vendor", F.explode("reasons").alias("reason"))
    return by_reason.unionByName(by_vendor).unionByName(by_both).groupBy("vendor", "reason").agg(F.count(F.lit(1)).alias("n"))


def undecided_share(aliases: DataFrame, labels: DataFrame, key: str, vendor: str) -> DataFrame:
    pairs = aliases.select(key, vendor).distinct().join(labels.select(key, "security_level").distinct(), key, "left")
    hit = F.coalesce(F.col("security_level") == c.UNDECIDED, F.lit(False)).cast("int")
    return pairs.groupBy(vendor).agg(F.sum(hit).alias("n"), F.count(F.lit(1)).alias("total"), F.round(F.avg(hit), 4).alias("share"))


def diverging_aliases(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns array): columns in which the aliases of a content differ; null is a value."""
    differs = [
        F.when(F.count_distinct(F.struct(x)) > 1, F.lit(x)).alias(f"d{i}") for i, x in enumerate(columns)
    ]
    checked = df.groupBy(key).agg(*differs)
    found = F.filter(F.array(*[F.col(f"d{i}") for i in range(len(columns))]), lambda x: x.isNotNull())
    return checked.select(key, found.alias("columns")).where(F.size("columns") > 0)


def collapse_aliases(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """One row for each content, the first by order; its aliases must agree in columns."""
    must_be_empty(diverging_aliases(df, key, columns), f"aliases of a {key} differ")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def provenance(df: DataFrame, key: str, alias: list[str], kept: DataFrame) -> DataFrame:
    """(key, in_table, aliases array<struct>), aliases in order."""
    nested = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*alias))).alias("aliases"))
    return nested.join(kept.select(key).distinct().withColumn("in_table", F.lit(True)), key, "left").select(
        key, F.coalesce("in_table", F.lit(False)).alias("in_table"), "aliases"
    )


def one_hot(df: DataFrame, column: str, categories: list[str], keep: bool = False) -> DataFrame:
    """column__category bytes of fixed categories, other (an empty text too) and
    missing (null only), in the place of the column.
    """
    value = F.col(column)
    tests = {x: value == x for x in categories}
    tests |= {c.OTHER: ~value.isin(*categories), c.MISSING: value.isNull()}
    new = [F.coalesce(t, F.lit(False)).cast("tinyint").alias(f"{column}__{x}") for x, t in tests.items()]
    out: list[Column] = []
    for x in df.columns:
        if x == column:
            out += [F.col(x)] * keep + new
        else:
            out.append(F.col(x))
    return df.select(out)


def multi_hot(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """One row for each key with a byte for each value that any of its rows has."""
    return df.groupBy(key).agg(*[F.max((F.col(column) == v).cast("tinyint")).alias(f"{column}__{v}") for v in values])


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column): those of at most one value, null counted as one."""
    counts = df.agg(*[(F.count_distinct(F.struct(x))).alias(x) for x in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("n")) for x in columns]))).where("n <= 1").select("column")


def vector_columns(columns: list[str], key: str = "firmware_id") -> tuple[list[str], dict[str, str]]:
    """The columns of a reported vector and why each other one is left out."""
    left_out: dict[str, str] = {}
    for x in columns:
        if x in c.ONE_HOT_SOURCES:
            left_out[x] = "one_hot"
        elif x in c.DEMOTED:
            left_out[x] = "demoted"
        elif x in c.FORBIDDEN or any(x.startswith(p) for p in c.FORBIDDEN_PREFIXES):
            left_out[x] = "forbidden"
    return [x for x in columns if x != key and x not in left_out], left_out


def support(df: DataFrame, group: str, label: str) -> DataFrame:
    """(class, n, n_groups): rows and groups that have each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("n_groups"))
    return counts.withColumnRenamed(label, "class")


def group_support(df: DataFrame, group: str, label: str, classes: list[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.count_if(F.col(label) == x).alias(f"n_{x}") for x in classes])


def multiset_signature(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, signature): equal for equal multisets of rows in any order.

    Sums of hashes and not a sorted list, so a group of any size is bounded.
    """
    h = F.sha2(F.concat_ws("\0", *[F.coalesce(F.concat(F.lit("="), x), F.lit("-")) for x in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", *[part(i) for i in (1, 13, 25, 37, 49)]).alias("signature"))


def finding_key(*columns: str) -> Column:
    """SHA-256 of the columns with NUL between them; null where one is null."""
    parts = [F.col(columns[0])]
    for x in columns[1:]:
        parts += [F.lit("\0"), F.col(x)]
    return F.sha2(F.concat(*parts), 256)


def vendor_merge(paths: DataFrame, origin: str, target: str, path: str = "path") -> DataFrame:
    """(source, moved_to, problem): where the files of a vendor's folder go in another's. paths
    are vendor/model/file; the model's underscores become hyphens. problem is null, or
    nested for what isn't a file of a model, two_sources where two models become one,
    occupied where the target's model has a file already. Nothing is moved by this.
    """
    parts = F.split(path, "/")
    files = paths.select(F.col(path).alias("source"), parts[0].alias("vendor"), F.get(parts, 1).alias("model"), F.get(parts, 2).alias("name"), (F.size(parts) != 3).alias("nested"))
    moves = files.where(F.col("vendor") == origin).withColumn("to", F.replace("model", F.lit("_"), F.lit("-")))
    sources = moves.where(~F.col("nested")).groupBy("to").agg((F.min("model") != F.max("model")).alias("two"))
    taken = files.where(F.col("vendor") == target).select(F.col("model").alias("to")).distinct().withColumn("taken", F.lit(True))
    told = moves.join(sources, "to", "left").join(taken, "to", "left")
    problem = F.when(F.col("nested"), "nested").when(F.col("two"), "two_sources").when(F.col("taken"), "occupied")
    return told.select("source", F.when(~F.col("nested"), F.concat_ws("/", F.lit(target), "to", "name")).alias("moved_to"), problem.alias("problem"))


def scoring_features(features: DataFrame, ids: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """One row for each id of ids, in whatever ids are asked for: the collapsed features of its
    aliases, null where it has none. Ids that aren't asked for are left out.
    """
    asked = ids.select(key).distinct()
    return asked.join(collapse_aliases(features.join(asked, key, "left_semi"), key, columns, order), key, "left").select(key, order, *columns)
