"""Stratified samples, intervals and decisions of a manual review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The inverse normal of 0.975.
Z95 = 1.959963984540054
SENSITIVE = ["hardcoded_passwords", "credential_pairs", "api_tokens"]
SHOWN = 160


def allocate(capacity: dict[str, int], target: int) -> tuple[dict[str, int], list[str]]:
    """Equal shares, the remainder to the first by name, what a stratum lacks in
    rounds by name to those with room; and who received in those rounds.
    """
    names = sorted(capacity)
    if not names:
        return {}, []
    share, extra = divmod(target, len(names))
    got = {n: min(capacity[n], share + (i < extra)) for i, n in enumerate(names)}
    received: list[str] = []
    while (lack := target - sum(got.values())) > 0:
        room = [n for n in names if got[n] < capacity[n]][:lack]
        if not room:
            break
        for n in room:
            got[n] += 1
        received += room
    return got, received


def allocation(df: DataFrame, stratum: str, target: int) -> DataFrame:
    """(stratum, capacity, quota); one row for each stratum, a bounded number, goes over the driver."""
    capacity = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    quota, _ = allocate(capacity, target)
    rows = [(n, capacity[n], quota[n]) for n in sorted(capacity)]
    return df.sparkSession.createDataFrame(rows, f"`{stratum}` string, capacity long, quota long")


def draw(df: DataFrame, key: str, stratum: str, quotas: DataFrame, seed: str) -> DataFrame:
    """The rows of each stratum with the least hashes of seed and key, as many as its
    quota: a sample without replacement that depends on the seed alone. The least of
    64 parts of a stratum are ranked, so none is sorted in one task.
    """
    h = F.sha2(F.concat_ws("/", F.lit(seed), F.col(key).cast("string")), 256)
    rows = df.join(quotas.select(stratum, "quota"), stratum).withColumns({"__h": h, "__part": F.pmod(F.xxhash64(key), F.lit(64))})
    for within in ([stratum, "__part"], [stratum]):
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*within).orderBy("__h", key))).where("__n <= quota")
    return rows.select(*df.columns)


def nth_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with nth, the place of a row among its keys' by order, from 0."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval, cut to 0 and 1; null without trials."""
    n = trials.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z / scale * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    some = trials > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def decide(yes: Column, no: Column, unsure: Column, cut: float = 0.5, least: int = 20, most_unsure: float = 0.5) -> Column:
    """keep, remove or reformulate, by the share of the undecided, the number of the
    decided and the interval against the cut, in this order.
    """
    low, high = wilson(yes, yes + no)
    share = F.coalesce(F.try_divide(unsure.cast("double"), (yes + no + unsure).cast("double")), F.lit(0.0))
    return (
        F.when(share > most_unsure, "reformulate")
        .when(yes + no < least, "reformulate")
        .when(low >= cut, "keep")
        .when(high < cut, "remove")
        .otherwise("reformulate")
    )


def redacted(detector: Column, source: Column) -> Column:
    """What may be shown of a finding's string."""
    digest = F.substring(F.sha2(source, 256), 1, 8)
    hidden = F.concat(F.lit("<redigido:len="), F.length(source), F.lit(",sha256="), digest, F.lit(">"))
    cut = F.when(F.length(source) > SHOWN, F.concat(F.substring(source, 1, SHOWN), F.lit("…"))).otherwise(source)
    return F.when(detector.isin(*SENSITIVE), hidden).otherwise(cut)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
