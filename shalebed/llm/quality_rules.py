"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Native plan. Each document gets integer measures. A sketch is a log-linear
histogram (exact below 64, 32 buckets for each further power of two, so values
are off by 1/32 at most): a table (lang, source, measure, bucket, n) made by a
plain grouped count. Two sketches merge by adding n, so those of a language and
of everything are sums of the sketches of its sources, not further scans.
Thresholds come from a group's own quantiles: a narrow fence from its quartiles
and a far one from its first and last hundredth, each spread times as far out as
the quantile is from the median. A group's fences are averaged with those of its
language, and these with those of all, by their numbers of rows. They are joined
back to the documents: one far outside in one thing, or outside in two, goes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, strip_white, table, words_of

#: measure: (expression, what it is about, whether it has lower fences)
MEASURES = {
    "symbols": ("1000 * n_symbols div nullif(word_chars, 0)", "signs", False),
    "dup_lines": ("1000 * n_dup_lines div nullif(n_lines, 0)", "repetition", False),
    "repeats": ("1000 * n_repeat_words div nullif(n_words, 0)", "repetition", False),
    "word_length": ("100 * word_chars div nullif(n_words, 0)", "words", True),
}
#: Percent of the quantiles of a sketch.
LEVELS = (1, 25, 50, 75, 99)
#: fence: (the quantile it is outside of, its sign)
FENCES = {"hi": (75, 1), "far_hi": (99, 1), "lo": (25, -1), "far_lo": (1, -1)}
SIDES = [f"{m}_{x}" for m, (_, _, two) in MEASURES.items() for x in FENCES if two or x.endswith("hi")]


def _repeat_words(windows: Column) -> Column:
    """Words covered by the 3-word windows that occur twice or more.

    windows: (hash, position) in order of hash. Positions whose neighbour has
    the same hash are put in order; each adds the words up to the next one, 3
    at most.
    """
    n = F.size(windows)
    repeated = F.filter(
        windows,
        lambda x, i: ((i > 0) & (F.get(windows, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(windows, i + 1)["h"] == x["h"])),
    )
    return F.sort_array(F.transform(repeated, lambda x: x["p"]))


def measure_texts(docs: DataFrame) -> DataFrame:
    """All columns of docs and, as long, n_words, word_chars, n_symbols, n_lines,
    n_dup_lines and n_repeat_words of the whole text. A null text has no words.
    Columns of these names are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop(*names)
    text = F.coalesce("text", F.lit(""))
    step = docs.withColumns({"__w": words_of(text), "__lines": F.filter(F.split(text, "\n", -1), lambda x: strip_white(x) != "")})
    step = step.withColumn(
        "__h",
        F.when(
            F.size("__w") > 3,
            F.transform(
                F.sequence(F.lit(0), F.size("__w") - 3),
                lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    sorted_windows = F.sort_array(F.transform("__h", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    step = step.withColumn("__s", F.when(repeats, sorted_windows))
    step = step.withColumn("__p", F.when(F.col("__s").isNotNull(), _repeat_words(F.col("__s"))))
    covered = F.aggregate(
        F.zip_with("__p", F.slice("__p", 2, F.size("__p")), lambda a, b: F.least(b - a, F.lit(3))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return step.select(
        *docs.columns,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__p").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def bucket_of(value: Column) -> Column:
    """The lower bound of the value's bucket."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift))


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): one sketch for each group and measure."""
    entries = F.array(*[F.struct(F.lit(m).alias("measure"), bucket_of(F.col(m)).alias("bucket")) for m in MEASURES])
    return measured.select(*keys, F.inline(entries)).groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str], prefix: str, spread: int) -> DataFrame:
    """One row for each group: size and the fences of each measure."""
    group = Window.partitionBy(*keys, "measure")
    ranked = sketches.select(
        "*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("all")
    )
    quantiles = ranked.groupBy(*keys, "measure").agg(
        F.max("all").alias("size"),
        *[F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bucket"))).alias(f"q{q}") for q in LEVELS],
    )
    columns = [F.max("size").alias(f"{prefix}_size")]
    for side in SIDES:
        name, fence = next((m, side.removeprefix(f"{m}_")) for m in MEASURES if side.startswith(f"{m}_"))
        q, sign = FENCES[fence]
        value = F.col(f"q{q}") + spread * (F.col(f"q{q}") - F.col("q50"))
        value = value if sign > 0 else F.greatest(value, F.lit(0))
        columns.append(F.max(F.when(F.col("measure") == name, value)).alias(f"{prefix}_{side}"))
    return quantiles.groupBy(*keys).agg(*columns)


def judge_quality(docs: DataFrame, spread: int = 3, shrink: int = 200) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of docs.

    Rows are judged by the fences of their language and source, averaged with
    those of the language as if it had shrink more rows, and these with those of
    all rows likewise: a small group has its language's fences, a large one its
    own, with no switch between. Null lang or source is a group of its own. A row
    goes if a measure is beyond a far fence or if measures about two different
    things (signs, repetition, words) are beyond the near ones.

    Rows without words fail the base rules. Only rows that pass them enter the
    sketches. Missing lang or source columns count as null; every other column is
    ignored. Repeated rows are judged one by one.
    """
    for name in ("lang", "source"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    return _judged(measure_texts(docs.select("doc_id", "lang", "source", "text")).drop("text"), spread, shrink)


def _beyond(measure: str, far: str) -> Column:
    expression, _, two_sided = MEASURES[measure]
    value = bucket_of(F.expr(expression))  # as the fences see it
    outside = value > F.col(f"fence_{measure}_{far}hi")
    return outside | (value < F.col(f"fence_{measure}_{far}lo")) if two_sided else outside


def _judged(measured: DataFrame, spread: int, shrink: int) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    measured = checkpointed(measured)  # small rows; the texts are not read and split again
    passed = measured.where(~F.col("base_failed")).withColumns({m: F.expr(e) for m, (e, _, _) in MEASURES.items()})
    by_source = checkpointed(sketch(passed, ["lang", "source"]))
    by_lang = merged(by_source, ["lang"])
    overall = merged(by_lang, [])
    source_fences = fences(by_source, ["lang", "source"], "s", spread)
    lang_fences = fences(by_lang, ["lang"], "l", spread).withColumnRenamed("lang", "l_lang")
    all_fences = fences(overall, [], "a", spread)
    # One row for each group; the documents meet this small table only.
    limits = source_fences.join(lang_fences, F.col("lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(F.broadcast(all_fences))
    for own, wider in (("l", "a"), ("s", "l")):
        limits = limits.withColumns({f"{own}_{x}": F.expr(f"({own}_{x} * {own}_size + {wider}_{x} * {shrink}) div ({own}_size + {shrink})") for x in SIDES})
    limits = limits.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[F.col(f"s_{x}").alias(f"fence_{x}") for x in SIDES])
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    judged = measured.join(limits, same, "left")
    far = reduce(lambda a, b: a | b, [_beyond(m, "far_") for m in MEASURES])
    about: dict[str, Column] = {}
    for m, (_, what, _) in MEASURES.items():
        about[what] = about[what] | _beyond(m, "") if what in about else _beyond(m, "")
    bad = far | (reduce(lambda a, b: a + b, [x.cast("int") for x in about.values()]) >= 2)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(~bad, F.lit(False))).alias("kept"),
        *[F.col(f"fence_{x}") for x in SIDES],
    )


def keep_good(docs: DataFrame, spread: int = 3, shrink: int = 200) -> DataFrame:
    """The rows of docs that judge_quality keeps, with the columns of docs.

    Rows of one doc_id that differ in text, lang or source (null and empty too)
    are judged apart, as the verdict is joined on the doc_id and a hash of these;
    rows equal in all of them share a verdict.
    """
    own = [c for x in ("lang", "source") if x in docs.columns for c in (F.col(x).isNull(), F.col(x))]
    shown = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), *own).alias("h")).alias("__key"), "*")
    named = [c for c in ("text", "lang", "source") if c in docs.columns]
    verdict = judge_quality(shown.select(F.col("__key").alias("doc_id"), *named), spread, shrink).where("kept").select("doc_id.*").distinct()
    verdict = verdict.select(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h"))
    same = F.col("__key.doc_id").eqNullSafe(F.col("k_id")) & (F.col("__key.h") == F.col("k_h"))
    return shown.join(verdict, same, "left_semi").drop("__key")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def _sql_fences() -> str:
    rows = [f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM passed" for m in MEASURES]
    columns = []
    for side in SIDES:
        name, fence = next((m, side.removeprefix(f"{m}_")) for m in MEASURES if side.startswith(f"{m}_"))
        q, sign = FENCES[fence]
        value = f"q{q} + 3 * (q{q} - q50)" if sign > 0 else f"greatest(q{q} + 3 * (q{q} - q50), 0)"
        columns.append(f"max(CASE WHEN measure = '{name}' THEN {value} END)::BIGINT AS {side}")
    quantiles = ", ".join(f"min(bucket) FILTER (upto * 100 >= total * {q}) AS q{q}" for q in LEVELS)
    levels = ", ".join(
        f"""{p}r AS (SELECT {k} AS gk, measure, bucket, sum(n) AS n FROM sk GROUP BY ALL),
        {p}c AS (SELECT *, sum(n) OVER (PARTITION BY gk, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY gk, measure) AS total FROM {p}r),
        {p}q AS (SELECT gk, measure, max(total)::BIGINT AS size, {quantiles} FROM {p}c GROUP BY ALL),
        {p} AS (SELECT gk, max(size) AS size, {", ".join(columns)} FROM {p}q GROUP BY gk)"""
        for p, k in (("s", "[lang, source]"), ("l", "[lang]"), ("a", "['']"))
    )
    shrunk = lambda own, wider: f"({own} * {{t}}.size + {wider} * 200) // ({{t}}.size + 200)"
    langs = ", ".join(shrunk(f"l.{x}", f"a.{x}").format(t="l") + f" AS {x}" for x in SIDES)
    sources = ", ".join(shrunk(f"s.{x}", f"m.{x}").format(t="s") + f" AS fence_{x}" for x in SIDES)

    def bucket(v: str) -> str:
        shift = f"(length(bin({v})) - 6)::INT"
        return f"CASE WHEN {v} < 64 THEN {v} ELSE ({v} >> {shift}) << {shift} END"

    def beyond(m: str, far: str) -> str:
        low = f" OR {bucket(f'm.{m}')} < fence_{m}_{far}lo" if MEASURES[m][2] else ""
        return f"({bucket(f'm.{m}')} > fence_{m}_{far}hi{low})"

    far = " OR ".join(beyond(m, "far_") for m in MEASURES)
    about: dict[str, list[str]] = {}
    for m, (_, what, _) in MEASURES.items():
        about.setdefault(what, []).append(beyond(m, ""))
    votes = " + ".join(f"({' OR '.join(own)})::INT" for own in about.values())
    return f"""values_ AS ({" UNION ALL ".join(rows)}),
      sk AS (SELECT lang, source, measure, {bucket("v")} AS bucket, count(*) AS n FROM values_ GROUP BY ALL),
      {levels},
      mixed AS (SELECT l.gk, {langs} FROM l CROSS JOIN a),
      limits AS (SELECT s.gk AS gk, {sources} FROM s JOIN mixed m ON m.gk[1] = s.gk[1])
      SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
             NOT base_failed AND coalesce(NOT ({far} OR {votes} >= 2), false) AS kept, {", ".join(f"fence_{x}" for x in SIDES)}
      FROM measured m LEFT JOIN limits g ON g.gk = [m.lang, m.source]"""


OP1_SQL = f"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) <> '') AS lines
  FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM base),
windows AS (SELECT doc_id, pos, x, lead(x, 1) OVER d AS y, lead(x, 2) OVER d AS z FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos FROM windows WHERE z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, x, y, z) >= 2),
covered AS (SELECT doc_id, count(DISTINCT pos + i) AS n FROM twice, range(3) r(i) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN covered c USING (doc_id)),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         1000 * n_symbols // nullif(word_chars, 0) AS symbols, 1000 * n_dup_lines // nullif(n_lines, 0) AS dup_lines,
         1000 * n_repeat_words // nullif(n_words, 0) AS repeats, 100 * word_chars // nullif(n_words, 0) AS word_length
  FROM counted),
passed AS (SELECT * FROM measured WHERE NOT base_failed),
{_sql_fences()}
"""
