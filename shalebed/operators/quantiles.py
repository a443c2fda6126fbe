"""Exact quantiles of groups of any size.

Values are counted before they are ordered. Ranges of keys and value are sorted apart, a
running sum within a range and the totals of the ranges before it give each value its
ranks, and the values at the wanted ranks come out of one grouped aggregate. No task holds
a group: a group that takes a third of all rows is spread over as many ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import checkpointed


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b, by keys that may be null."""
    other = b.withColumnsRenamed({k: f"__key{i}" for i, k in enumerate(keys)})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)], F.lit(True))
    return a.join(other, same, how).drop(*[f"__key{i}" for i in range(len(keys))])


def with_ranks(counts: DataFrame, order: list[str], n: str) -> DataFrame:
    """counts (one row for each order) with __before, the sum of n over all rows that come
    before by order. A row for each range goes over the driver.
    """
    placed = checkpointed(counts.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    starts, before = [], 0
    for r in placed.groupBy("__range").agg(F.sum(n).alias("n")).orderBy("__range").collect():
        starts.append((r["__range"], before))
        before += r["n"]
    starts = counts.sparkSession.createDataFrame(starts, "__range int, __start long")
    running = F.sum(n).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("__running", running).join(F.broadcast(starts), "__range").withColumn("__before", F.col("__start") + F.col("__running") - F.col(n)).drop("__range", "__running", "__start")


def quantiles(counts: DataFrame, keys: list[str], value: str, n: str, wanted: list[float]) -> DataFrame:
    """(keys, q): array<double> of the wanted quantiles, linear between the neighbouring
    ranks, of counts (keys, value, n: how often it occurs).

    Null values take no part; a group of nothing else has no row. NaN is greater than any
    number. Keys may be null. Equal rows of counts are added up.
    """
    counted = counts.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(n).alias("__n"))
    ranked = checkpointed(with_ranks(counted, [*keys, value], "__n"))
    groups = ranked.groupBy(*keys).agg(F.min("__before").alias("__first"), F.sum("__n").alias("__total"))
    both = joined(ranked, groups, keys).withColumn("__from", F.col("__before") - F.col("__first")).withColumn("__value", F.col(value).cast("double"))
    places = [F.lit(q) * (F.col("__total") - 1) for q in wanted]
    holds = lambda rank: (F.col("__from") <= rank) & (rank < F.col("__from") + F.col("__n"))
    ends = [F.max(F.when(holds(f(p)), F.col("__value"))).alias(f"__{name}{i}") for i, p in enumerate(places) for name, f in (("low", F.floor), ("high", F.ceil))]
    found = both.groupBy(*keys, "__total").agg(*ends)

    def between(i: int):
        p, low, high = places[i], F.col(f"__low{i}"), F.col(f"__high{i}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return found.select(*keys, F.array(*[between(i) for i in range(len(wanted))]).alias("q"))
