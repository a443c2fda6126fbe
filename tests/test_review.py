"""Review, report tables, contract checks and paths on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shalebed.functions import versions
from shalebed.operators import checks, metrics, report, review

FINDINGS = "detector string, firmware_id string, path string, source string, context string"


def marked(spark, rows, excluded=()):
    keys = spark.createDataFrame([(d, f, p, s, c) for d, f, p, s, c in excluded], FINDINGS)
    keys = keys.select(review.finding_key("detector", "firmware_id", "source", "context").alias("finding_key"))
    return review.marked(spark.createDataFrame(rows, FINDINGS), keys)


def test_population(spark):
    rows = [
        ("urls", "1", "b/m/f", "x", ""), ("urls", "1", "b/m/e", "x", ""), ("urls", "1", "b/m/e", "y", ""), ("urls", "1", "b/m/f", "y", ""),
        ("urls", "2", "a/m/f", "x", ""), ("urls", "3", "a/m/f", "z", ""), ("urls", "3", "b/m/f", "z", ""), ("urls", "4", "c/m/f", "x", ""), ("urls", "4", "c/m/g", "xx", ""),
    ]
    totals = review.path_totals(marked(spark, rows, [("urls", "2", "a/m/f", "x", "")]))
    assert {r.firmware_id for r in review.differing_aliases(totals).collect()} == {"3", "4"}
    found = {r.firmware_id: (r.vendor, r.path, r.kept) for r in review.population(totals).collect()}
    assert found == {"1": ("b", "b/m/e", 2), "3": ("a", "a/m/f", 1), "4": ("c", "c/m/f", 1)}
    empty = review.path_totals(marked(spark, []))
    assert review.population(empty).count() == review.differing_aliases(empty).count() == 0


def test_draw(spark):
    rows = [(d, str(i), f"{v}/m/f", f"s{j}", "") for d in ("a", "b") for v, n in (("x", 2), ("y", 9)) for i in range(100 * (v == "y"), 100 * (v == "y") + n) for j in range(3)]
    findings = marked(spark, rows)
    chosen = review.population(review.path_totals(findings))
    quota = review.quotas(chosen, 8)
    assert {(r.detector, r.vendor): (r.quota, r.received) for r in quota.collect()} == {(d, v): q for d in "ab" for v, q in (("x", (2, 0)), ("y", (6, 2)))}
    drawn = review.picks(chosen, quota, "7")
    both = {tuple(r) for r in drawn.collect()}
    alone = {tuple(r) for r in review.picks(chosen.where("detector = 'a'"), quota, "7").collect()}
    assert len(both) == 16 and {r for r in both if r[0] == "a"} == alone
    lined = findings.withColumn("line", F.concat_ws("/", "detector", "firmware_id", "source"))
    sheet = review.sheet(review.picked(lined, drawn, "line").drop("finding_key"), "7", "R-", "line", "v1").collect()
    assert sorted(r.item_id for r in sheet) == [f"R-{n:03d}" for n in range(1, 17)]
    assert len({(r.detector, r.firmware_id) for r in sheet}) == 16 and all(r.classe == "" for r in sheet)
    assert [r.line for r in sorted(sheet, key=lambda r: r.item_id)] != sorted(r.line for r in sheet)


def test_annotation_errors(spark):
    columns = ["detector", *review.ANNOTATIONS, "rubrica_versao"]
    good = ["urls", review.TRUE, "V1", "", "", "seen", "2024-02-29", "v1"]
    cases = [
        ({}, []), ({"classe": "?"}, ["class"]), ({"classe": None}, ["class"]), ({"criterio": "F1"}, ["criterion"]), ({"criterio": None}, ["criterion"]),
        ({"classe": review.UNSURE, "criterio": "IND"}, ["reason_presence"]), ({"classe": review.UNSURE, "criterio": "IND", "motivo_ind": "r2"}, ["reason"]),
        ({"classe": review.UNSURE, "criterio": "IND", "motivo_ind": "r1"}, []), ({"motivo_ind": "r1"}, ["reason_presence"]), ({"subtipo": "k"}, ["subtype"]),
        ({"detector": "api_tokens"}, ["subtype"]), ({"detector": "api_tokens", "subtipo": "k"}, []), ({"detector": "new"}, ["criterion"]), ({"justificativa": "  "}, ["justification"]),
        ({"data": "2023-02-29"}, ["date"]), ({"data": None}, ["date"]), ({"data": "2023-12-31", "rubrica_versao": None}, ["rubric_version", "date_before_rubric"]),
    ]
    rows = [(i, *[change.get(c, g) for c, g in zip(columns, good)]) for i, (change, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} string" for c in columns))
    both = {"urls": ["V1"], "api_tokens": ["V1"]}
    errors = review.annotation_errors(both, {"urls": ["F1"]}, {"api_tokens": ["k"]}, ["r1"], "v1", "2024-01-01")
    assert [r.e for r in df.select("i", errors.alias("e")).orderBy("i").collect()] == [e for _, e in cases]


def test_summary(spark):
    rows = [("a", f"v{i % 2}", "V1", review.TRUE) for i in range(30)] + [("b", "v0", "F1", review.FALSE)] * 30 + [("c", "v0", "V1", review.TRUE)] * 19 + [("d", "v0", "IND", review.UNSURE)] * 2 + [("d", "v0", "V1", review.TRUE)]
    df = spark.createDataFrame(rows, "detector string, fabricante string, criterio string, classe string")
    told = {r.detector: r for r in review.summary(df, list("abcde")).collect()}
    assert {d: r.decision for d, r in told.items()} == {"a": "manter", "b": "retirar", "c": "reformular", "d": "reformular", "e": None}
    assert told["e"].reason == "absent" and told["e"].by_vendor is None and told["e"].low is None
    assert [tuple(v) for v in told["a"].by_vendor] == [("v0", 15, 0, 0), ("v1", 15, 0, 0)] and [tuple(x) for x in told["d"].criteria] == [("IND", 2), ("V1", 1)]


def test_scenario_without_rows(spark):
    df = spark.createDataFrame([("g1", "1", "1", "0", "x"), ("g2", "0", "0", "0", "x")], "g string, y string, a string, b string, v string")
    told = {r.scenario: r for r in report.scenario_table(df, metrics.draw_resamples(df, "g", 5), "g", "y", "a", "b", "v", "none", ["0", "1"]).collect()}
    assert told["without_vendor"].status == report.NOT_APPLICABLE and told["without_vendor"].first is None
    assert told["all"].first == 1.0 and told["all"].n_groups == 2
    rows = [(F.lit("x"), spark.createDataFrame([(None, None, None), (0.5, 0.1, 0.9)], "delta double, delta_low double, delta_high double"))]
    assert report.delta_rows([(df, label) for label, df in rows]).count() == 1


def test_interpretations(spark):
    df = spark.createDataFrame([(0.0, 0.1, 0.2), (0.1, 0.0, 0.2), (0.1, 0.01, 0.0), (-0.1, -0.3, -0.01)], "d double, l double, h double")
    assert [r[0] for r in df.select(report.gain(F.col("d"), F.col("l"))).collect()] == [report.NOT_BETTER, report.UNCLEAR, report.BETTER, report.NOT_BETTER]
    assert [r[0] for r in df.select(report.loss(F.col("h"))).collect()] == [report.NOT_WORSE] * 3 + [report.WORSE]


def test_orders(spark):
    df = spark.createDataFrame([("b", 1), ("z", 0), ("a", 2), ("a", 1)], "m string, r int")
    assert [tuple(r) for r in report.in_order(df, "m", ["b", "a"], "r").collect()] == [("b", 1), ("a", 1), ("a", 2), ("z", 0)]
    drops = spark.createDataFrame([("b", 0.1), ("a", 0.1), ("c", 0.3)], "feature string, drop double")
    assert [r.feature for r in report.importance_table(drops).collect()] == ["c", "a", "b"]
    missing = report.missing_classes(spark.createDataFrame([("f", "x"), ("f", None), ("f", "odd"), ("g", "x"), ("g", "y")], "k string, y string"), ["k"], "y", ["y", "x"])
    assert [tuple(r) for r in missing.collect()] == [("f", ["y"])]


def test_checks(spark):
    aliases = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "a"), ("2", "b"), ("3", None)], "id string, vendor string")
    ids = spark.createDataFrame([("1",), ("9",)], "id string")
    assert {tuple(r) for r in checks.vendor_issues(aliases, "id", "vendor", ids).collect()} == {("2", "several"), ("3", "null"), ("9", "no alias")}
    with pytest.raises(ValueError):
        checks.vendor_of_id(aliases, "id", "vendor")
    one = aliases.where("id = '1'")
    assert [tuple(r) for r in checks.vendor_of_id(one, "id", "vendor").collect()] == [("1", "a")]
    folds = spark.createDataFrame([("1", "g", "test"), ("1", "g", "train")], "id string, group string, role string")
    assert [tuple(r) for r in checks.out_of_fold_frame(folds, one, "id", "vendor", "a").collect()] == [("1", "g", 1, "a", True)]
    with pytest.raises(ValueError):
        checks.out_of_fold_frame(folds, one, "id", "vendor", "zz")
    with pytest.raises(ValueError):
        checks.tested(folds.withColumn("role", F.lit("test")), "id")
    with pytest.raises(ValueError):
        checks.encoded(one, "vendor", spark.createDataFrame([("b", 0)], "vendor string, n int"), "n")
    good = spark.createDataFrame([("1", "0", 1.0)], "firmware_id string, level string, entropy double")
    assert checks.table_issues(good, "firmware_id", "level", ["0"]).count() == 0
    assert checks.input_issues(good, good, "firmware_id", ["entropy"], ["level"]).count() == 0


def test_paths(spark):
    cases = {
        "Acme/AB-1_1.2.b3/f.bin": ("acme", "ab-1", "acme_ab-1", "1.2.b3", "directory"), "belkin/F5D/x_1.00.12.bin": ("belkin", "f5d", "belkin_f5d", "1.00.12", "filename"),
        "belkin/F5D/dd-wrt.WebFlash_1.00.12.bin": ("belkin", "f5d", "belkin_f5d", None, None), "acme/AB_1.2/f.bin": ("acme", "ab_1.2", "acme_ab_1.2", None, None),
        "./acme//m1/f": ("acme", "m1", "acme_m1", None, None), "/acme/m1/f": (None,) * 5, "acme/../m/f": (None,) * 5, "acme/m/x/f": (None,) * 5, "acme/ /f": (None,) * 5, "": (None,) * 5,
    }
    df = spark.createDataFrame([(p, e) for p, e in cases.items()], "p string, e array<string>")
    for r in df.select("p", "e", versions.path_identity(F.col("p")).alias("i")).collect():
        assert list(r.i) == r.e, r.p
    roots = spark.createDataFrame([("/d/a/m/f", False), ("/d2/a/m/f", True), ("/d/a/f", True), ("/d/../a/m/f", True), (None, True)], "p string, off boolean")
    for r in roots.select("p", "off", versions.off_layout(F.col("p"), F.lit("/d/")).alias("o")).collect():
        assert r.o == r.off, r.p
