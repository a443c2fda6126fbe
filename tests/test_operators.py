"""Applicability, labels, corpus, groups, metrics, score and sampling on literal cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from shalebed.functions import contract as c
from shalebed.operators import applicability as A
from shalebed.operators import corpus, describe, groups, labels, metrics, models, sampling, score

SOFTWARE = "cpe:2.3:o:acme:m1_firmware:%s:%s:*:*:*:*:*:*"
HARDWARE = "cpe:2.3:h:acme:m1:%s:*:*:*:*:*:*:*"
OTHER = "cpe:2.3:o:acme:zz_firmware:*:*:*:*:*:*:*:*"
NETGEAR = "cpe:2.3:o:netgear:r1_firmware:%s:*:*:*:*:*:*:*"
ANY = SOFTWARE % ("*", "*")


def tree(*nodes, operator=None):
    return json.dumps([{"nodes": list(nodes)} | ({"operator": operator} if operator else {})])


def match(criteria, vulnerable=True, **bounds):
    return {"vulnerable": vulnerable, "criteria": criteria} | bounds


def node(*matches, **more):
    return {"cpeMatch": list(matches)} | more


TREES = [
    ("1.2", tree(node(match(ANY, versionEndExcluding="1.3"))), True),
    ("1.3", tree(node(match(ANY, versionEndExcluding="1.3.0"))), False),
    ("1.2", tree(node(match(SOFTWARE % ("*", "beta")))), None),
    ("1.2", tree(node(match(OTHER))), False),
    ("1.2", "[]", None),
    (None, tree(node(match(ANY))), None),
    (None, tree(node(match(OTHER))), False),
    ("x", tree(node(match(ANY))), None),
    ("1.2", tree(node(match(ANY), match(HARDWARE % "-", False), operator="AND")), True),
    ("1.2", tree(node(match(ANY), match(HARDWARE % "b1", False), operator="AND")), None),
    ("1.2", tree(node(match(SOFTWARE % ("1.2", "*")), negate=True)), False),
    ("1.2", tree(node(operator="AND", children=[node(match(SOFTWARE % ("1.2", "*"))), node(match(SOFTWARE % ("9", "*")))])), False),
    ("1.2", tree(node(operator="AND", children=[node(match(ANY)), node(match(OTHER))])), None),
    ("1.2", tree(node(match(SOFTWARE % ("-", "*")))), None),
    ("1.2b", tree(node(match(SOFTWARE % ("1.2", "*")))), None),
    ("1.2b", tree(node(match(SOFTWARE % ("1.2B", "*")))), True),
    ("1.2b", tree(node(match(SOFTWARE % ("1.2c", "*")))), False),
    ("1.2", tree(node(match(SOFTWARE % ("1.2c", "*")))), None),
    ("1.2", tree(node(match(ANY, versionEndIncluding="1.2b3"))), None),
    ("1.1", tree(node(match(ANY, versionEndIncluding="1.2b3"))), True),
    ("1.2", tree(node(match(ANY, versionStartIncluding="?"))), None),
    ("1.2", tree(node(match(ANY, versionStartIncluding="1.3", versionEndIncluding="1.2b1"))), False),
    ("1.2", tree(node()), None),
    ("1.2", tree(node(match(ANY)), node(match(SOFTWARE % ("9", "*"))), operator="AND"), False),
    ("1.2", tree(node(match("broken"))), None),
]


def test_trees(spark):
    rows = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(TREES)], "i int, version string, configurations string")
    target = A.target_of(F.lit(None).cast("string"), F.lit("Acme"), F.lit("M1 Firmware"))
    found = {r.i: r.verdict for r in A.judge(rows.withColumn("target", target)).collect()}
    assert found == {i: e for i, (_, _, e) in enumerate(TREES)}


def test_what_repeats_is_judged_once(spark, monkeypatch):
    given = [(v, t) for v, t, _ in TREES[:6]] + [(None, TREES[0][1]), (TREES[0][0], None), (None, None)]
    rows = spark.createDataFrame([(i, *given[i % len(given)]) for i in range(40)], "i int, version string, configurations string")
    target = A.target_of(F.lit(None).cast("string"), F.lit("Acme"), F.when(F.col("i") % 2 == 0, "M1 Firmware"))
    rows = rows.withColumn("target", target)
    each = {r.i: (r.verdict, r.only_others) for r in A._judged(rows).collect()}
    seen, judged = [], A._judged
    monkeypatch.setattr(A, "_judged", lambda df: seen.append(df.count()) or judged(df))
    assert {r.i: (r.verdict, r.only_others) for r in A.judge(rows).collect()} == each and len(each) == 40
    assert seen == [rows.select("version", "configurations", "target").distinct().count()] and seen[0] < 40


def test_deep_trees(spark):
    """The innermost node decides at every depth, and none is left out silently."""
    def chain(n, last):
        return node(last) if n == 0 else node(match(ANY), operator="AND", children=[chain(n - 1, last)])

    false, true = match(SOFTWARE % ("9", "*")), match(ANY)
    empty = node(match(ANY), operator="AND", children=[node()])
    cases = [(f"{n}{kind}", tree(chain(n, kind == "t" and true or false)), kind == "t") for n in range(9) for kind in "tf"] + [("empty", tree(empty), None)]
    rows = spark.createDataFrame([(i, "1.2", t) for i, t, _ in cases], "i string, version string, configurations string")
    target = A.target_of(F.lit(None).cast("string"), F.lit("Acme"), F.lit("M1 Firmware"))
    assert {r.i: r.verdict for r in A.judge(rows.withColumn("target", target)).collect()} == {i: e for i, _, e in cases}


def judged_by_hand(tree, verdict_of, other_of):
    """Recursion over a parsed tree; verdict_of(match, unrelated) judges a match."""
    def combined(results, operator):
        first = operator != "AND"  # the verdict that decides alone
        if first in results:
            return first
        return None if None in results or not results else not first

    def judged(n, unrelated):
        operator = n.get("operator", "OR")
        unrelated = unrelated or operator == "AND"
        v = combined([verdict_of(m, unrelated) for m in n.get("cpeMatch", [])] + [judged(c, unrelated) for c in n.get("children", [])], operator)
        return v if v is None or not n.get("negate") else not v

    def named(n):
        return [m["criteria"] for m in n.get("cpeMatch", [])] + [x for c in n.get("children", []) for x in named(c)]

    own, others = [], 0
    for config in tree:
        names = [x for n in config["nodes"] for x in named(n)]
        if names and all(map(other_of, names)):
            others += 1
            continue
        operator = config.get("operator", "OR")
        own.append(combined([judged(n, operator == "AND") for n in config["nodes"]], operator))
    if not tree:
        return None, False
    return (combined(own, "OR") if own else False), others == len(tree)


def test_random_trees(spark):
    """Trees of any shape against recursion; 40 levels are no limit."""
    rng = random.Random(4)
    yes, no, unsure = SOFTWARE % ("1.2", "*"), SOFTWARE % ("9", "*"), SOFTWARE % ("-", "*")

    def grown(depth):
        n = node(*[match(rng.choice([yes, no, unsure, OTHER])) for _ in range(rng.randrange(3))])
        if rng.random() < 0.5:
            n["operator"] = rng.choice(["AND", "OR"])
        if rng.random() < 0.3:
            n["negate"] = True
        if depth and rng.random() < 0.7:
            n["children"] = [grown(depth - 1) for _ in range(rng.randrange(1, 4))]
        return n

    trees = [json.loads(tree(*[grown(3) for _ in range(rng.randrange(1, 3))], operator=rng.choice([None, "AND"]))) for _ in range(150)]
    trees += [a + b for a, b in zip(trees[:40], trees[40:80], strict=True)] + [[]]
    long = node(match(no))
    for k in range(40):
        long = node(match(yes), operator=rng.choice(["AND", "OR"]), negate=k % 3 == 0, children=[long])
    trees += [[{"nodes": [long]}]]
    facts = {yes: True, no: False, unsure: None}
    verdict_of = lambda m, unrelated: (None if unrelated else False) if m["criteria"] == OTHER else facts[m["criteria"]]
    rows = spark.createDataFrame([(i, "1.2", json.dumps(t)) for i, t in enumerate(trees)] + [(-1, "1.2", "{broken"), (-2, "1.2", None)], "i int, version string, configurations string")
    target = A.target_of(F.lit(None).cast("string"), F.lit("Acme"), F.lit("M1 Firmware"))
    found = {r.i: (r.verdict, r.only_others) for r in A.judge(rows.repartition(3).withColumn("target", target)).collect()}
    assert found == {i: judged_by_hand(t, verdict_of, lambda c: c == OTHER) for i, t in enumerate(trees)} | {-1: (None, False), -2: (None, False)}
    assert len(set(found.values())) >= 4


def test_netgear_package(spark):
    cases = [("1.0.1.80", "1.0.1.80_1.0.75", None), ("1.0.1.81", "1.0.1.80_1.0.75", False), ("1.0.1.80", "v1.0.1.80", True)]
    rows = spark.createDataFrame([(i, v, tree(node(match(NETGEAR % e)))) for i, (v, e, _) in enumerate(cases)], "i int, version string, configurations string")
    target = A.target_of(F.lit("cpe:2.3:o:netgear:r1_firmware:*:*:*:*:*:*:*:*"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert {r.i: r.verdict for r in A.judge(rows.withColumn("target", target)).collect()} == {i: e for i, (_, _, e) in enumerate(cases)}


def test_evidence_state(spark):
    df = spark.createDataFrame([(0, A.FOUND, [], [True, True]), (1, A.FOUND, ["x"], [True]), (2, A.FOUND, [], [True, False]), (3, "x", [], [True]), (4, A.FOUND, [], [])], "i int, s string, c array<string>, o array<boolean>")
    assert dict(df.select("i", A.effective_state(F.col("s"), F.col("c"), F.col("o"))).collect()) == {0: A.NOT_FOUND, 1: A.FOUND, 2: A.FOUND, 3: "x", 4: A.FOUND}


def test_bounds(spark):
    """A label is decided only where applicable and undecided evidence agree."""
    judged = spark.createDataFrame(
        [("a", "1", 9.5, True, 1), ("b", "1", 5.0, True, 1), ("b", "2", 9.0, None, 1), ("c", "1", 5.0, None, 1), ("c", "1", 5.0, True, 2), ("d", "1", 9.9, False, 1), ("f", "1", 9.9, True, 1)],
        "fw string, cve_id string, score double, verdict boolean, nth int",
    )
    keys = spark.createDataFrame([("a", False), ("b", False), ("c", False), ("d", False), ("e", True), ("f", True), ("f", False)], "fw string, not_found boolean")
    found = {r.fw: (r.security_level, r.cve_total, r.evidence_reason) for r in labels.bounded_labels(keys, judged, "fw").collect()}
    assert found == {
        "a": (c.CRITICAL, 1, None), "b": (c.UNDECIDED, 1, None), "c": (c.KNOWN, 1, None), "d": (c.NO_KNOWN, 0, None),
        "e": (c.UNDECIDED, 0, c.NOT_FOUND), "f": (c.CRITICAL, 1, c.NOT_FOUND),
    }


def test_alias_evidence(spark):
    judged = spark.createDataFrame([("a", 1, "z", True), ("a", 1, "b", True), ("a", 1, "n", None), ("a", 2, "q", False)], "fw string, alias int, cve_id string, verdict boolean")
    found = {r.alias: (r.applicable_cves, r.indeterminate_cves) for r in labels.alias_evidence(judged, ["fw", "alias"]).collect()}
    assert found == {1: (["b", "z"], ["n"]), 2: ([], [])}


# Corpus --------------------------------------------------------------------


def test_divergence_counts_null(spark):
    df = spark.createDataFrame([("a", 1, None, "p1"), ("a", 1, 2, "p2"), ("b", 1, None, "p3"), ("b", 1, None, "p4")], "k string, x int, y int, path string")
    assert [tuple(r) for r in corpus.diverging_aliases(df, "k", ["x", "y"]).collect()] == [("a", ["y"])]
    with pytest.raises(ValueError, match="'a'"):
        corpus.collapse_aliases(df, "k", ["x", "y"], "path")
    assert corpus.collapse_aliases(df, "k", ["x"], "path").count() == 2
    assert [r[0] for r in corpus.constant_columns(df, ["x", "y"]).collect()] == ["x"]


def test_one_hot_missing_is_not_empty(spark):
    df = spark.createDataFrame([(1, "squashfs"), (2, "yaffs2"), (3, None), (4, "")], "i int, fs_type string")
    out = corpus.one_hot(df, "fs_type", ["squashfs", "cramfs"])
    rows = {r.i: (r.fs_type__squashfs, r.fs_type__cramfs, r.fs_type__outro, r.fs_type__ausente) for r in out.collect()}
    assert rows == {1: (1, 0, 0, 0), 2: (0, 0, 1, 0), 3: (0, 0, 0, 1), 4: (0, 0, 1, 0)}
    assert dict(out.dtypes)["fs_type__outro"] == "tinyint"


def test_exclusions(spark):
    state = {"meta_binwalk_status": "ok", "meta_unpack_status": "ok", "meta_fs_status": "ok"}
    rows = [("x", "p1", "a", "erro", "dd-wrt"), ("x", "p2", "b", "ok", None), ("y", "p3", "a", "ok", None), ("z", "p4", "a", "ok", None)]
    df = spark.createDataFrame(rows, "firmware_id string, meta_path string, vendor string, meta_binwalk_status string, meta_third_party string")
    df = df.withColumns({k: F.lit(v) for k, v in state.items() if k != "meta_binwalk_status"})
    undecided = spark.createDataFrame([("x", c.UNDECIDED), ("z", c.UNDECIDED), ("y", c.KNOWN)], "firmware_id string, security_level string")
    reasons = corpus.exclusion_reasons(df, undecided)
    assert {r.firmware_id: r.reasons for r in reasons.collect()} == {"x": c.REASONS, "z": ["indeterminado"]}
    report = {(r.vendor, r.reason): r.n for r in corpus.exclusion_report(reasons, corpus.vendors_by_id(df, "firmware_id", "vendor"), "firmware_id").collect()}
    assert report["a", None] == 2 and report["b", None] == 1 and report[None, "indeterminado"] == 2 and report["b", "terceiros"] == 1


def test_checked_joins(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="repeated"):
        corpus.checked_join(left, right, "k")
    with pytest.raises(ValueError, match="missing"):
        corpus.lookup_join(left, right, "k")


def test_vector_columns():
    kept, left_out = corpus.vector_columns(["firmware_id", "entropy", "fs_type", "has_debug_account", "meta_path", "vendor", "doc2vec_0"])
    assert kept == ["entropy"] and left_out == {"fs_type": "one_hot", "has_debug_account": "demoted", "meta_path": "forbidden", "vendor": "forbidden", "doc2vec_0": "forbidden"}


def test_signature_ignores_order(spark):
    rows = [("p", "a"), ("p", "b"), ("p", "a"), ("q", "b"), ("q", "a"), ("q", "a"), ("r", "a"), ("r", "b"), ("r", "b")]
    s = {r.k: r.signature for r in corpus.multiset_signature(spark.createDataFrame(rows, "k string, v string"), ["k"], ["v"]).collect()}
    assert s["p"] == s["q"] != s["r"]


def test_prevalence(spark):
    df = spark.createDataFrame([("acme", 1), ("acme", None), ("beta", 0), ("beta", 1)], "vendor string, t int").withColumn("none", F.lit(None).cast("int"))
    found = {(r.column, r.vendor): (r.n, r.n_missing, r.n_present, r.ratio) for r in describe.prevalence(df, "vendor", ["t", "none"]).collect()}
    assert found["t", "*"] == (4, 1, 2, pytest.approx(2 / 3)) and found["t", "acme"] == (2, 1, 1, 1.0)
    assert found["none", "*"][:3] == (4, 4, 0) and found["none", "*"][3] != found["none", "*"][3]


def test_coverage(spark):
    df = spark.createDataFrame([("A", "v", x) for x in (0.0, 0.0, 0.25, 0.75, 1.0, None)], "g string, v string, x double")
    r = describe.coverage(df, ["g"], "v", ["x"]).where("v = '*'").first()
    assert (r.n, r.missing, r.q1, r.median, r.q3, r["mean"], r.is_small) == (6, 1, 0.0, 0.25, 0.75, pytest.approx(0.4), False)


# Groups --------------------------------------------------------------------


def least_of_groups(pairs):
    """Union and find."""
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for i, m in pairs:
        top[find(("id", i))] = find(("model", m))
    least = {}
    for i, _ in pairs:
        least[find(("id", i))] = min(i, least.get(find(("id", i)), i))
    return {i: f"g:{least[find(('id', i))]}" for i, _ in pairs}


def test_links_get_fewer(spark, monkeypatch):
    rng = random.Random(3)
    dense = [(i, rng.randrange(100)) for i in range(500) for _ in range(8)]
    rows = []
    stored = groups.checkpointed
    monkeypatch.setattr(groups, "checkpointed", lambda df: rows.append((out := stored(df)).count()) or out)
    df = spark.createDataFrame(dense, "id long, model long")
    assert dict(groups.connected_groups(df, "id", "model").collect()) == least_of_groups(dense)
    assert sum(rows) < 1000 < len(dense)  # neither links nor labels of all ids are kept in each round
    sparse = [(rng.randrange(300), rng.randrange(280)) for _ in range(330)]
    order = rng.sample(range(120), 120)
    chain = [(1000 + order[i + k], 1000 + i) for i in range(119) for k in (0, 1)] + [(2000 + i + k, 3000 + i) for i in range(60) for k in (0, 1)]
    df = spark.createDataFrame(sparse + chain, "id long, model long")
    assert dict(groups.connected_groups(df, "id", "model").collect()) == least_of_groups(sparse + chain)


def test_groups(spark):
    links = spark.createDataFrame([("b", "B"), ("a", "A"), ("a", "B"), ("c", "C")], "id string, model string")
    assert dict(groups.connected_groups(links, "id", "model").collect()) == {"a": "g:a", "b": "g:a", "c": "g:c"}
    chain = spark.createDataFrame([(f"{i:03}", f"m{j}") for i in range(60) for j in (i, i + 1)], "id string, model string")
    assert {g for _, g in groups.connected_groups(chain, "id", "model").collect()} == {"g:000"}


def test_folds_keep_groups_and_classes(spark):
    rng = random.Random(4)
    rows = [(i, f"g{i // 3}", "xyz"[rng.randrange(3)]) for i in range(240)]
    table = spark.createDataFrame(rows, "id int, group string, y string")
    folds = groups.grouped_folds(table, "id", "group", "y", 4, seed=7)
    assert groups.not_tested_once(folds, "id").count() == 0
    links = table.select("id", F.col("group").alias("model"))
    assert groups.crossings(folds, links, "id", "model").count() == 0
    summary = groups.fold_summary(folds, table, "id", "y", list("xyz")).where("role = 'test'").collect()
    assert len(summary) == 4 and all(abs(r.n - 60) <= 6 and min(r.n_x, r.n_y, r.n_z) >= 12 for r in summary)
    broken = folds.withColumn("role", F.when((F.col("id") == 0) & (F.col("fold") == 0), "test").otherwise(F.col("role")))
    assert groups.crossings(broken, links, "id", "model").count() + groups.not_tested_once(broken, "id").count() > 0


# Metrics -------------------------------------------------------------------


def test_confusion(spark):
    rows = [(0, "a", "a"), (0, "a", "b"), (0, "b", "b"), (0, "b", "c"), (0, "c", "c")]
    m = metrics.confusion(spark.createDataFrame(rows, "repeat int, y string, p string"), ["repeat"], "y", "p", ["a", "b", "c"])
    assert tuple(m.first())[1:] == (1, 1, 0, 0, 1, 1, 0, 0, 1)
    r = metrics.macro_metrics(m, ["repeat"], ["a", "b", "c"]).first()
    assert r.macro_f1 == pytest.approx(11 / 18) and r.balanced_accuracy == pytest.approx(2 / 3) and r.accuracy == pytest.approx(3 / 5)


def test_undefined_metrics(spark):
    m = metrics.confusion(spark.createDataFrame([("a", "a")], "y string, p string"), [], "y", "p", ["a", "b"])
    rows = {r["class"]: (r.precision, r.recall, r.f1, r.undefined) for r in metrics.class_metrics(m, [], ["a", "b"]).collect()}
    assert rows == {"a": (1.0, 1.0, 1.0, []), "b": (0.0, 0.0, 0.0, ["precision", "recall", "f1"])}


def test_identical_arms(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(f"g{i % 9}", rng.choice("ab"), rng.choice("ab")) for i in range(90)], "g string, y string, p string").withColumn("q", F.col("p"))
    drawn = metrics.draw_resamples(df, "g", 40, seed=3)
    assert drawn.groupBy("resample").agg(F.sum("k").alias("k")).where("k <> 9").count() == 0
    assert sorted(drawn.collect()) == sorted(metrics.draw_resamples(df.repartition(5), "g", 40, seed=3).collect())
    r = metrics.paired_bootstrap(df, drawn, "g", "y", "p", "q", ["a", "b"]).first()
    assert (r.delta, r.delta_low, r.delta_high) == (0.0, 0.0, 0.0) and r.first_low <= r.first_high


def test_permutation(spark):
    df = spark.createDataFrame([(i % 2, i, float(i)) for i in range(40)], "fold int, id int, x double")
    dealt = models.permuted(df, ["fold"], "x", 5)
    assert sorted(r.x for r in dealt.collect()) == sorted(r.x for r in df.collect())
    assert {(r.fold, r.x) for r in dealt.collect()} == {(r.fold, r.x) for r in df.collect()}
    assert dealt.where("x <> id").count() > 20


# Score and sampling --------------------------------------------------------


def test_score(spark):
    df = spark.createDataFrame(
        [(0, 7.0, None, False, None), (1, 8.0, 5, True, None), (2, None, None, None, 0), (3, 6.0, None, True, None)],
        "i int, entropy double, count_hardcoded_passwords int, has_telnetd boolean, n_filesystems int",
    )
    rows = {r.i: r for r in score.rule_score(df).collect()}
    assert rows[0].score == pytest.approx(0.5) and rows[0].level == c.KNOWN and rows[0].hard_rule is None
    assert rows[1].level == c.CRITICAL and rows[1].hard_rules == ["has_telnetd", "hardcoded_passwords"] and rows[1].hard_rule is None
    assert rows[2].score == 0.0 and rows[2].level == c.NO_KNOWN and rows[2].score_binwalk is None
    assert rows[3].score == 0.0 and rows[3].level == c.KNOWN and rows[3].hard_rule == "has_telnetd"


def test_allocation():
    got, received = sampling.allocate({"asus": 3, "belkin": 1, "dlink": 4, "netgear": 1, "tp_link": 12}, 20)
    assert got == {"asus": 3, "belkin": 1, "dlink": 4, "netgear": 1, "tp_link": 11} and len(received) == 7
    assert sampling.allocate({"a": 10, "b": 10, "c": 10}, 20)[0] == {"a": 7, "b": 7, "c": 6}
    assert sampling.allocate({"a": 1}, 5)[0] == {"a": 1} and sampling.allocate({}, 5) == ({}, [])


def test_wilson_and_decisions(spark):
    rows = [(15, 5, 0, "keep"), (14, 6, 0, "reformulate"), (5, 15, 0, "remove"), (10, 0, 11, "reformulate"), (0, 0, 0, "reformulate")]
    df = spark.createDataFrame(rows, "y int, n int, u int, e string")
    low, high = sampling.wilson(F.col("y"), F.col("y") + F.col("n"))
    out = df.select("*", low.alias("low"), high.alias("high"), sampling.decide(F.col("y"), F.col("n"), F.col("u")).alias("d")).collect()
    assert [r.d for r in out] == [r.e for r in out]
    assert (round(out[0].low, 4), round(out[0].high, 4)) == (0.5313, 0.8881) and out[4].low is None


def test_draw_is_stable(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(50)], "id int, s string")
    quotas = sampling.allocation(df, "s", 11)
    one = {r.id for r in sampling.draw(df, "id", "s", quotas, "7/x").collect()}
    assert len(one) == 11 and one == {r.id for r in sampling.draw(df.repartition(6), "id", "s", quotas, "7/x").collect()}
    assert one != {r.id for r in sampling.draw(df, "id", "s", quotas, "8/x").collect()}


def test_folds_of_many_groups(spark):
    """More groups than once went over the driver; every group is in one test part."""
    n = 200_003
    table = spark.range(n).select("id", F.col("id").alias("group"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("y"))
    test = groups.grouped_folds(table, "id", "group", "y", 5, seed=3).where("role = 'test'")
    rows = test.join(table.select("id", "y"), "id").groupBy("fold").agg(F.count_if(F.col("y") == "a").alias("a"), F.count_if(F.col("y") == "b").alias("b")).collect()
    assert len(rows) == 5 and sum(r.a + r.b for r in rows) == n == test.select("id").distinct().count()
    assert all(max(r[y] for r in rows) - min(r[y] for r in rows) <= 1 for y in "ab")
