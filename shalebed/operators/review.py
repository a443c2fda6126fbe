"""Manual review of findings: population, draw, annotation errors and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import numbered
from .corpus import finding_key
from .sampling import allocate, wilson

# Fixed values of annotated tables.
TRUE, FALSE, UNSURE = "verdadeiro_candidato", "falso_positivo", "indeterminado"
UNSURE_CODE = "IND"
ANNOTATIONS = ["classe", "criterio", "motivo_ind", "subtipo", "justificativa", "data"]
PATH_KEYS = ["detector", "firmware_id", "path"]


def _vendor(path: Column) -> Column:
    return F.split(path, "/")[0]


def marked(findings: DataFrame, excluded: DataFrame) -> DataFrame:
    """Findings with finding_key and whether that is one of excluded (finding_key)."""
    keyed = findings.withColumn("finding_key", finding_key("detector", "firmware_id", "source", "context"))
    return keyed.join(excluded.select("finding_key").distinct().withColumn("excluded", F.lit(True)), "finding_key", "left").withColumn(
        "excluded", F.coalesce("excluded", F.lit(False))
    )


def path_totals(findings: DataFrame) -> DataFrame:
    """(detector, firmware_id, path, total, digest, kept) of marked findings; digest is
    the same for the same keys as often, in any order.
    """
    half = lambda at: F.sum(F.conv(F.substring("finding_key", at, 15), 16, 10).cast("decimal(38,0)"))
    return findings.groupBy(*PATH_KEYS).agg(
        F.count(F.lit(1)).alias("total"), F.struct(half(1), half(16), half(31)).alias("digest"), F.count_if(~F.col("excluded")).alias("kept")
    )


def differing_aliases(totals: DataFrame) -> DataFrame:
    """(detector, firmware_id) whose paths have other findings or other vendors."""
    seen = F.struct("total", "digest")
    vendor = _vendor(F.col("path"))
    return (
        totals.groupBy("detector", "firmware_id")
        .agg((F.min(seen) != F.max(seen)).alias("findings"), (F.min(vendor) != F.max(vendor)).alias("vendors"))
        .where("findings OR vendors")
        .select("detector", "firmware_id")
    )


def population(totals: DataFrame) -> DataFrame:
    """(detector, vendor, firmware_id, path, kept): the least path with findings left
    stands for its firmware; those without any left aren't there.
    """
    left = totals.where("kept > 0").groupBy("detector", "firmware_id").agg(F.min(F.struct("path", "kept")).alias("one"))
    return left.select("detector", _vendor(F.col("one.path")).alias("vendor"), "firmware_id", "one.path", "one.kept")


def population_summary(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("detector", "vendor").agg(F.count(F.lit(1)).alias("n_firmware"), F.sum("kept").alias("n_findings"))


def quotas(chosen: DataFrame, target: int) -> DataFrame:
    """(detector, vendor, capacity, quota, received) for target firmware a detector;
    received counts what other vendors couldn't fill. One row for each detector and
    vendor, a bounded number, goes over the driver.
    """
    capacity: dict[str, dict[str, int]] = {}
    for r in chosen.groupBy("detector", "vendor").count().collect():
        capacity.setdefault(r["detector"], {})[r["vendor"]] = r["count"]
    rows = []
    for detector in sorted(capacity):
        quota, received = allocate(capacity[detector], target)
        rows += [(detector, v, n, quota[v], received.count(v)) for v, n in sorted(capacity[detector].items())]
    return chosen.sparkSession.createDataFrame(rows, "detector string, vendor string, capacity long, quota long, received long")


def _drawn_hash(seed: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws("/", F.lit(seed), *columns), 256)


def picks(chosen: DataFrame, quota: DataFrame, seed: str) -> DataFrame:
    """(detector, vendor, firmware_id, path, nth): of each detector and vendor as many
    firmware as its quota, those with the least hashes, and for each the place of one
    finding among those left. What is drawn for one detector is the same without the
    others. The least of 64 parts are ranked, so no vendor is sorted in one task.
    """
    h = _drawn_hash(seed, "detector", "firmware_id")
    rows = chosen.join(quota.select("detector", "vendor", "quota"), ["detector", "vendor"]).withColumns({"__h": h, "__part": F.pmod(F.xxhash64("firmware_id"), F.lit(64))})
    for within in (["detector", "vendor", "__part"], ["detector", "vendor"]):
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*within).orderBy("__h", "firmware_id"))).where("__n <= quota")
    place = F.conv(F.substring("__h", 9, 12), 16, 10).cast("long") % F.col("kept")
    return rows.select("detector", "vendor", "firmware_id", "path", place.alias("nth"))


def picked(findings: DataFrame, drawn: DataFrame, line: str) -> DataFrame:
    """The marked findings at the drawn places by order of line, which no two share.
    Findings of drawn paths only are numbered, so a window holds one path's.
    """
    left = findings.where("NOT excluded").join(drawn, PATH_KEYS)
    place = F.row_number().over(Window.partitionBy(*PATH_KEYS).orderBy(line)) - 1
    return left.withColumn("__place", place).where("__place = nth").drop("__place", "nth", "excluded")


def sheet(items: DataFrame, seed: str, prefix: str, line: str, rubric: str) -> DataFrame:
    """Items in an order drawn by the seed, numbered from 1 in item_id, with the
    source's digest, the rubric's version and empty columns for annotations.
    """
    dealt = numbered(items.withColumn("__h", _drawn_hash(seed, line)), ["__h", line], "__n")
    n = (F.col("__n") + 1).cast("string")
    number = F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    empty = [F.lit("").alias(a) for a in ANNOTATIONS]
    return dealt.select(
        F.concat(F.lit(prefix), number).alias("item_id"), *items.columns, F.sha2("source", 256).alias("source_sha256"), F.lit(rubric).alias("rubrica_versao"), *empty
    )


def _of_detector(codes: dict[str, list[str]]) -> Column:
    """The codes of the row's detector; none of an unknown one."""
    none = F.array().cast("array<string>")
    chosen = F.when(F.lit(False), none)
    for detector, values in codes.items():
        chosen = chosen.when(F.col("detector") == detector, F.array(*[F.lit(v) for v in values]).cast("array<string>"))
    return chosen.otherwise(none)


def annotation_errors(true_codes: dict[str, list[str]], false_codes: dict[str, list[str]], subtypes: dict[str, list[str]], reasons: list[str], version: str, frozen: str) -> Column:
    """array<string> of the rules that an annotated row breaks; nulls count as empty.

    An unknown class is told alone. frozen: the rubric's date, YYYY-MM-DD.
    """
    own = {a: F.coalesce(F.col(a), F.lit("")) for a in [*ANNOTATIONS, "rubrica_versao"]}
    label, criterion, reason, subtype = (own[a] for a in ANNOTATIONS[:4])
    allowed = F.when(label == TRUE, _of_detector(true_codes)).when(label == FALSE, _of_detector(false_codes)).otherwise(F.array(F.lit(UNSURE_CODE)))
    kinds = _of_detector(subtypes)
    wanted = (label == TRUE) & (F.size(kinds) > 0)
    day = F.when(own["data"].rlike(r"^\d{4}-\d{2}-\d{2}$"), own["data"].try_cast("date"))
    rules = {
        "criterion": ~F.array_contains(allowed, criterion),
        "reason_presence": (label == UNSURE) != (reason != ""),
        "reason": (label == UNSURE) & (reason != "") & ~reason.isin(*reasons),
        "subtype": (wanted != (subtype != "")) | ((subtype != "") & ~F.array_contains(kinds, subtype)),
        "justification": F.trim(own["justificativa"]) == "",
        "rubric_version": own["rubrica_versao"] != version,
        "date": day.isNull(),
        "date_before_rubric": F.coalesce(day < F.lit(frozen).cast("date"), F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return F.when(label.isin(TRUE, FALSE, UNSURE), broken).otherwise(F.array(F.lit("class")))


def decision(yes: Column, no: Column, unsure: Column, cut: float = 0.5, least: int = 20, most_unsure: float = 0.5) -> Column:
    """struct<decision, reason, low, high>: the first rule that holds."""
    low, high = wilson(yes, yes + no)
    told = lambda d, r: F.struct(F.lit(d).cast("string").alias("decision"), F.lit(r).alias("reason"), low.alias("low"), high.alias("high"))
    return (
        F.when(yes + no + unsure == 0, told(None, "absent"))
        .when(unsure > (yes + no + unsure) * most_unsure, told("reformular", "too many unsure"))
        .when(yes + no < least, told("reformular", "too few decided"))
        .when(low >= cut, told("manter", "low end reaches cut"))
        .when(high < cut, told("retirar", "high end below cut"))
        .otherwise(told("reformular", "interval holds cut"))
    )


def summary(rows: DataFrame, detectors: list[str], **rule) -> DataFrame:
    """One row for each of detectors, those without items too: n_true, n_false,
    n_unsure, decision, reason, low, high, by_vendor (sorted structs of counts) and
    criteria (sorted structs). Counted before they are gathered.
    """
    n = lambda label: F.coalesce(F.sum(F.when(F.col("classe") == label, F.col("n"))), F.lit(0)).alias
    counts = [n(TRUE)("n_true"), n(FALSE)("n_false"), n(UNSURE)("n_unsure")]
    cells = rows.groupBy("detector", "fabricante", "criterio", "classe").agg(F.count(F.lit(1)).alias("n"))
    vendors = cells.groupBy("detector", "fabricante").agg(*counts)
    by_vendor = F.sort_array(F.collect_list(F.struct("fabricante", "n_true", "n_false", "n_unsure"))).alias("by_vendor")
    totals = vendors.groupBy("detector").agg(*[F.sum(c).alias(c) for c in ("n_true", "n_false", "n_unsure")], by_vendor)
    codes = cells.groupBy("detector", "criterio").agg(F.sum("n").alias("n")).groupBy("detector").agg(F.sort_array(F.collect_list(F.struct("criterio", "n"))).alias("criteria"))
    every = rows.sparkSession.createDataFrame([(d,) for d in detectors], "detector string")
    joined = every.join(totals, "detector", "left").join(codes, "detector", "left").fillna(0, ["n_true", "n_false", "n_unsure"])
    return joined.select("*", decision(F.col("n_true"), F.col("n_false"), F.col("n_unsure"), **rule).alias("__d")).select(
        "detector", "n_true", "n_false", "n_unsure", "__d.*", "by_vendor", "criteria"
    )
