"""Whether a vulnerability applies to a version, in three-valued logic.

A configuration tree is JSON of any depth. Its nodes become rows, a level at a time; what
a node states itself is a Column expression, and verdicts go up in grouped aggregates.
Verdicts are nullable booleans: null is undecided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import let, unknown
from ..functions.storage import checkpointed
from ..functions.versions import canonical, canonical_product, parse_version, product_of, version_in_range, versions_equal

# Fixed values.
NUMERIC = r"^\d+(?:\.\d+)*$"
NETGEAR_PACKAGE = r"^(\d+(?:\.\d+){2,3})_\d+(?:\.\d+)*$"
BUILD_BOUND = r"^(\d+(?:\.\d+)*)(?:[._-]?([A-Za-z]+)(\d+)?([A-Za-z]*))?$"
BOUNDS = ["versionStartIncluding", "versionStartExcluding", "versionEndIncluding", "versionEndExcluding"]
FOUND, NOT_FOUND = "cve_encontrada", "nao_encontrado"

_MATCH = "struct<vulnerable: boolean, criteria: string, " + ", ".join(f"{b}: string" for b in BOUNDS) + ">"

# What is below a node is read as text, a level at a time.
_NODE = f"struct<operator: string, negate: boolean, cpeMatch: array<{_MATCH}>, children: array<string>>"
_CONFIGURATIONS = "array<struct<operator: string, nodes: array<string>>>"


def nodes_by_level(trees: DataFrame, keep: list[str]) -> list[DataFrame]:
    """The nodes of the trees of trees (__row, configurations, an array of _CONFIGURATIONS,
    and the columns keep), a table for each level: keep, __row, config, node (its places
    from the root, joined by dots), parent, operator, negate, unrelated, cpeMatch.

    unrelated: whether a node from here up to the configuration joins by AND. A level is
    read from the text that the one above left, so trees may be of any depth; there are
    as many rounds as levels.
    """
    operator = F.coalesce("c.operator", F.lit("OR"))
    config = trees.select("__row", *keep, F.posexplode("configurations").alias("config", "c"))
    below = config.select("__row", *keep, "config", F.lit("").alias("parent"), (operator == "AND").alias("above"), F.posexplode("c.nodes").alias("place", "text"))
    levels = []
    while True:
        read = below.withColumn("n", F.from_json("text", _NODE)).withColumn("operator", F.coalesce("n.operator", F.lit("OR")))
        level = checkpointed(
            read.select(
                "__row", *keep, "config", F.concat_ws(".", F.nullif("parent", F.lit("")), "place").alias("node"), "parent", "operator", F.coalesce("n.negate", F.lit(False)).alias("negate"),
                (F.col("above") | (F.col("operator") == "AND")).alias("unrelated"), F.col("n.cpeMatch").alias("cpeMatch"), F.col("n.children").alias("children"),
            )
        )
        levels.append(level.drop("children"))
        some = level.where(F.size("children") > 0)
        if some.isEmpty():
            return levels
        below = some.select("__row", *keep, "config", F.col("node").alias("parent"), F.col("unrelated").alias("above"), F.posexplode("children").alias("place", "text"))


def _seen(verdict: Column) -> list[Column]:
    """Aggregates that say which of the three verdicts occur; all that three-valued logic needs."""
    return [F.bool_or(F.coalesce(verdict, F.lit(False))).alias("yes"), F.bool_or(F.coalesce(~verdict, F.lit(False))).alias("no"), F.bool_or(verdict.isNull()).alias("unsure")]


def _verdict(operator: Column) -> Column:
    """The verdict of columns yes, no and unsure (null where nothing is given)."""
    yes, no, unsure = (F.coalesce(F.col(c), F.lit(False)) for c in ("yes", "no", "unsure"))
    every = F.when(no, F.lit(False)).when(yes & ~unsure, F.lit(True))
    some = F.when(yes, F.lit(True)).when(no & ~unsure, F.lit(False))
    return F.when(operator == "AND", every).otherwise(some)


def target_of(cpe_name: Column, vendor: Column, model: Column) -> Column:
    """struct<vendor, product> by the CPE name of 13 fields, else by vendor and model, else null."""
    parts = F.split(cpe_name, ":")
    named = F.struct(canonical(F.get(parts, 3)).alias("vendor"), canonical_product(F.get(parts, 4)).alias("product"))
    plain = F.struct(canonical(vendor).alias("vendor"), canonical_product(model).alias("product"))
    return F.when(F.size(parts) == 13, named).when(vendor.isNotNull() & model.isNotNull(), plain)


def _normalized(value: Column, vendor: Column) -> tuple[Column, Column]:
    """A version as its vendor writes it, and whether a package was taken off."""
    bare = F.regexp_replace(value, r"^[vV](?=\d)", "")
    packed = (vendor == "netgear") & bare.rlike(NETGEAR_PACKAGE)
    text = F.when(vendor == "asus", F.replace(bare, F.lit("_"), F.lit("."))).when(packed, F.regexp_extract(bare, NETGEAR_PACKAGE, 1)).otherwise(bare)
    return text, F.coalesce(packed, F.lit(False))


class Firmware:
    """The columns of a firmware: its version as written and as numbers, and its target."""

    def __init__(self, raw: Column, version: Column, target: Column):
        self.raw, self.version, self.target = raw, version, target
        self.numeric = raw.rlike(NUMERIC)

    @classmethod
    def of(cls, df: DataFrame, version: str, target: str) -> tuple[DataFrame, Firmware]:
        """df with what the rules use of a version as columns, and the rules on them."""
        df = df.withColumn("__raw", F.trim(version)).withColumn("__version", parse_version(F.col("__raw")))
        return df, cls(F.col("__raw"), F.col("__version"), F.col(target))

    def is_target(self, product: Column) -> Column:
        return (product["vendor"] == self.target["vendor"]) & (product["product"] == self.target["product"])

    def platform(self, p: Column) -> Column:
        """A product that isn't vulnerable: the target's own hardware without a revision holds."""
        own = (p["part"] == "h") & self.is_target(p) & p["version"].isin("-", "*")
        return F.when(F.coalesce(own, F.lit(False)), F.lit(True)).otherwise(unknown())

    def exact(self, written: Column) -> Column:
        def compared(x: Column) -> Column:
            text, packed, parsed = x["text"], x["packed"], x["parsed"]
            same = versions_equal(self.version, parsed)
            numbers = text.rlike(NUMERIC)
            longer = F.startswith(F.lower(text), F.lower(self.raw)) & ~F.substring(text, F.length(self.raw) + 1, F.lit(1)).rlike("^[A-Za-z0-9]?$")
            return (
                F.when(written == "-", unknown())
                .when((written == "*") | (F.lower(written) == F.lower(self.raw)), F.lit(True))
                .when(parsed.isNull() | (packed & same), unknown())
                .when(~same, F.lit(False))
                .when(numbers, F.when(self.numeric, F.lit(True)).otherwise(unknown()))
                .when(self.numeric | longer, unknown())
                .otherwise(F.lit(False))
            )

        return let(self._read(written, self.target["vendor"]), compared)

    def _read(self, written: Column, vendor: Column) -> Column:
        text, packed = _normalized(written, vendor)
        return let(
            F.struct(text.alias("text"), packed.alias("packed")),
            lambda x: F.struct(x["text"].alias("text"), x["packed"].alias("packed"), parse_version(x["text"]).alias("parsed")),
        )

    def _bound(self, value: Column) -> Column:
        """struct<bad, build, number>: unreadable, of the same number with a build, or a number in effect."""
        text, packed = _normalized(value, F.coalesce(self.target["vendor"], F.lit("")))

        def parts(x: Column) -> Column:
            number = parse_version(F.regexp_extract(x["text"], BUILD_BOUND, 1))
            return F.struct(
                (~x["text"].rlike(BUILD_BOUND)).alias("odd"), x["packed"].alias("packed"), number.alias("number"),
                versions_equal(self.version, number).alias("same"), (F.regexp_extract(x["text"], BUILD_BOUND, 2) != "").alias("build"),
            )

        def told(x: Column) -> Column:
            build = x["build"] & x["same"]
            return F.struct((x["odd"] | (x["packed"] & x["same"])).alias("bad"), build.alias("build"), F.when(~build, x["number"]).alias("number"))

        read = let(let(F.struct(F.trim(text).alias("text"), packed.alias("packed")), parts), told)
        return F.when(value.isNotNull(), read)

    def bounds(self, match: Column) -> Column:
        def judged(b: Column) -> Column:
            given = [F.get(b, i) for i in range(len(BOUNDS))]
            some = lambda field: F.exists(b, lambda x: F.coalesce(x[field], F.lit(False)))
            return (
                F.when(some("bad"), unknown())
                .when(F.exists(b, lambda x: x.isNotNull()) & ~self.numeric, unknown())
                .when(~version_in_range(self.version, *[g["number"] for g in given]), F.lit(False))
                .when(some("build"), unknown())
                .otherwise(F.lit(True))
            )

        return let(F.array(*[self._bound(match[name]) for name in BOUNDS]), judged)

    def match(self, match: Column, unrelated_unknown: Column) -> Column:
        """The verdict of a cpeMatch."""

        def named(p: Column) -> Column:
            specific = ~p["update"].isin("*", "-")
            return (
                F.when(p.isNull() | self.target.isNull(), unknown())
                .when(~self.is_target(p), F.when(unrelated_unknown, unknown()).otherwise(F.lit(False)))
                .otherwise(
                    let(
                        self.exact(p["version"]),
                        lambda e: F.when(e.isNull() | ~e, e).otherwise(let(self.bounds(match), lambda b: F.when(b & specific, unknown()).otherwise(b))),
                    )
                )
            )

        def told(p: Column) -> Column:
            vulnerable = F.when(match["criteria"].isNull(), self.bounds(match)).otherwise(named(p))
            return F.when(F.coalesce(match["vulnerable"], F.lit(False)), vulnerable).otherwise(self.platform(p))

        return let(product_of(match["criteria"]), told)


def effective_state(state: Column, candidates: Column, only_others: Column) -> Column:
    """A keyword hit without product candidates that names only other products wasn't found.

    only_others: array<boolean> of the entry's vulnerabilities.
    """
    none = F.coalesce(F.size(candidates), F.lit(0)) <= 0
    all_others = (F.size(only_others) > 0) & F.forall(only_others, lambda x: x)
    return F.when((state == FOUND) & none & all_others, F.lit(NOT_FOUND)).otherwise(state)


def judge(df: DataFrame) -> DataFrame:
    """df (version, target, configurations as JSON) with verdict and only_others
    instead of the configurations.

    What repeats is judged once: verdicts are those of _judged over the distinct versions,
    targets and configurations, and go to the rows by 128-bit hashes of these.
    """
    given = ["version", "target", "configurations"]
    # Null and absent parts count as parts, as a hash leaves out nulls.
    parts = [*given, *[F.col(c).isNull() for c in given], F.col("target.vendor").isNull(), F.col("target.product").isNull()]
    hashes = {f"__h{i}": F.xxhash64(F.lit(i), *parts) for i in (0, 1)}
    told = checkpointed(_judged(df.select(*given).distinct().withColumns(hashes)).select(*hashes, "verdict", "only_others"))
    return df.withColumns(hashes).drop("configurations").join(told, list(hashes)).drop(*hashes)


def _judged(df: DataFrame) -> DataFrame:
    """judge, row by row.

    Trees become rows, a node each, and verdicts are folded level by level from the
    leaves by grouped aggregates, so their depth has no limit. Text that is no JSON counts
    as no configurations: undecided. Configurations that name other products only are
    left out; if all are, the verdict is false. Without a readable version none applies:
    undecided.
    """
    rows, firmware = Firmware.of(df, "version", "target")
    rows = checkpointed(rows.withColumn("configurations", F.from_json("configurations", _CONFIGURATIONS)).withColumn("__row", F.monotonically_increasing_id()))
    own = ["__raw", "__version", "target"]
    levels = nodes_by_level(rows.select("__row", *own, "configurations"), own)
    node = ["__row", "config", "node"]

    # All matches of all levels are judged in one pass.
    matches = None
    for depth, level in enumerate(levels):
        one = level.select(*node, *own, F.lit(depth).alias("level"), "unrelated", F.explode("cpeMatch").alias("m"))
        matches = one if matches is None else matches.unionByName(one)
    # Stored, so that the rules aren't planned once more for each level.
    matches = checkpointed(matches).withColumn("p", product_of(F.col("m.criteria")))
    other = F.col("target").isNotNull() & F.col("p").isNotNull() & ~F.coalesce(firmware.is_target(F.col("p")), F.lit(False))
    judged = checkpointed(
        matches.select(*node, "level", firmware.match(F.col("m"), F.col("unrelated")).alias("verdict"), F.when(F.col("m.criteria").isNotNull(), other).alias("other"))
        .groupBy(*node, "level").agg(*_seen(F.col("verdict")), F.bool_and("other").alias("other"))
    )

    below = None
    for depth in range(len(levels) - 1, -1, -1):
        seen = judged.where(F.col("level") == depth).select(*node, "yes", "no", "unsure")
        if below is not None:
            seen = seen.unionByName(below).groupBy(*node).agg(*[F.bool_or(c).alias(c) for c in ("yes", "no", "unsure")])
        told = levels[depth].select(*node, "parent", "operator", "negate").join(seen, node, "left").withColumn("v", _verdict(F.col("operator")))
        told = told.withColumn("v", F.when(F.col("negate"), ~F.col("v")).otherwise(F.col("v")))
        below = told.groupBy("__row", "config", F.col("parent").alias("node")).agg(*_seen(F.col("v")))
        if depth:
            below = checkpointed(below)

    others = judged.groupBy("__row", "config").agg(F.bool_and("other").alias("other"))
    config = rows.select("__row", F.posexplode("configurations").alias("config", "c")).select("__row", "config", F.coalesce("c.operator", F.lit("OR")).alias("operator"))
    config = config.join(below.drop("node"), ["__row", "config"], "left").join(others, ["__row", "config"], "left")
    config = config.select("__row", _verdict(F.col("operator")).alias("v"), F.coalesce("other", F.lit(False)).alias("other"))
    mine = [F.bool_or(F.col(c) & ~F.col("other")).alias(c) for c in ("yes", "no", "unsure")]
    flags = config.select("__row", "other", F.coalesce("v", F.lit(False)).alias("yes"), F.coalesce(~F.col("v"), F.lit(False)).alias("no"), F.col("v").isNull().alias("unsure"))
    trees = flags.groupBy("__row").agg(F.bool_and("other").alias("only_others"), *mine)
    verdict = F.when(F.col("only_others"), F.lit(False)).when(F.col("__version").isNotNull(), _verdict(F.lit("OR")))
    out = rows.drop("configurations").join(trees, "__row", "left")
    return out.withColumns({"verdict": verdict, "only_others": F.coalesce("only_others", F.lit(False))}).drop("__row", "__raw", "__version", "yes", "no", "unsure")


def verdicts(aliases: DataFrame, cves: DataFrame, on: list[str]) -> DataFrame:
    """Each alias with each vulnerability of its entry, judged.

    aliases: on, version, target; cves: on, cve_id, configurations.
    """
    return judge(aliases.join(cves, on))
