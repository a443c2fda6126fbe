"""Strings, versions and logic on literal cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shalebed.functions import logic, strings, versions
from shalebed.functions.byte_stats import ByteStatistics, byte_features


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_runs(spark):
    text = strings.binary_text(F.lit(b"foo\x00ABCDEF" * 3 + b"\xff" + b"z" * 20 + b"\x00END"))
    row = one(
        spark, a=strings.printable_runs(F.lit("a\0b"), 0), b=strings.printable_runs(F.lit("abcdef"), 4, 3), c=strings.printable_runs(F.lit("abcd"), 4, 0),
        d=strings.printable_runs(text, 4, 17),
    )
    assert row.a == ["a", "b"] and row.b == ["abc"] and row.c == ["a"]
    assert row.d == ["ABCDEFfoo", "ABCDEFfoo", "ABCDEF", "z" * 17]


def test_document(spark):
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate(["admin", "admin", "guest", "password"])], "k int, pos int, s string")
    row = strings.build_documents(s, "k", 2, 8).first()
    assert (row.document, row.n_strings, row.truncated) == ("admin\ngu", 2, True)
    row = strings.build_documents(s, "k", 10, 100).first()
    assert (row.document, row.n_strings, row.truncated) == ("admin\nguest\npassword", 3, False)


def test_byte_features(spark):
    docs = spark.createDataFrame([(1, b""), (2, b"\x00\xff"), (3, None), (4, b"\x00\x01" * 4 + b"\x05" * 9)], "k int, c binary")
    found = {r.k: tuple(r.b) for r in docs.select("k", byte_features(F.col("c"), section=8).alias("b")).collect()}
    assert found[1] == found[3] == (0.0, 0.0, 1.0, 0, 0.0)
    assert found[2][:2] == (1.0, 127.5)
    assert found[4][3:] == (2, 0.25)  # entropies 1 and 0; the ninth byte is no full section


def test_pieces_dont_matter():
    data = np.random.default_rng(42).integers(0, 40, 2 * 65_536 + 113).astype(np.uint8).tobytes()
    results = set()
    for size in (len(data), 4093, 65_536, 65_537):
        stats = ByteStatistics()
        for at in range(0, len(data), size):
            stats.update(data[at : at + size])
        results.add(stats.result())
    assert len(results) == 1


@pytest.mark.parametrize(("raw", "expected"), [("7.10(ABTG.4)C0", [7, 10]), ("v1.2.3", None), ("", None), (" 3 ", [3]), ("1.0.0", [1, 0, 0])])
def test_parse_version(spark, raw, expected):
    assert one(spark, v=versions.parse_version(F.lit(raw))).v == expected


@pytest.mark.parametrize(
    ("version", "bounds", "expected"),
    [
        ("7.10", {"start_including": "7.10.0", "end_including": "7.10.0"}, True),
        ("1.2.4", {"end_excluding": "1.2.3"}, False),
        ("1.2", {"start_excluding": "1.2.0"}, False),
        ("1.2", {}, True),
        ("10.0", {"start_including": "9.9", "end_excluding": "10.0.1"}, True),
    ],
)
def test_ranges(spark, version, bounds, expected):
    v = versions.parse_version(F.lit(version))
    assert one(spark, x=versions.version_in_range(v, **{k: versions.parse_version(F.lit(b)) for k, b in bounds.items()})).x is expected


@pytest.mark.parametrize(
    ("brand", "name", "expected"),
    [
        ("netgear", "R6250-V1.0.1.80_1.0.75.chk", "1.0.1.80"),
        ("asus", "RT-AC66U_B1_3.0.0.4_384_32738-gc9a116a.trx", "3.0.0.4.384.32738"),
        ("dlink", "FW1.14_V1.14.bin", "1.14"),
        ("dlink", "x_1.2_1.3.bin", None),
        ("dlink", "x_2.15.B01.bin", None),
        ("Belkin ", "F9K v1.0.2%28x%29.bin", "1.0.2"),
        ("asus", "RT-N10+_2.1.1.1%zz.trx", None),
        ("other", "a_1.2.3.bin", None),
    ],
)
def test_infer_version(spark, brand, name, expected):
    assert one(spark, v=versions.infer_version(F.lit(brand), F.lit(name))).v == expected


def test_escapes(spark):
    assert one(spark, a=versions.unquoted(F.lit("RT-N10+%20x")), b=versions.unquoted(F.lit("50%zz"))) == ("RT-N10+ x", "50%zz")


def test_variants(spark):
    v = one(spark, v=versions.search_variants(F.lit("dir300"), F.lit("d-link"))).v
    assert v[0] == "d-link DIR-300" and "d-link DIR300" in v
    assert one(spark, v=versions.search_variants(F.lit("f5d_4"), F.lit("belkin"))).v == ["belkin F5D-4", "belkin F5D 4"]


def test_scores(spark):
    none, some = F.lit(None).cast("array<double>"), F.array(F.lit(4.0), F.lit(7.5))
    assert one(spark, a=versions.best_score(none, some, F.array(F.lit(9.9))), b=versions.best_score(none, none, none)) == (7.5, 0.0)
    assert one(spark, a=versions.severity_bucket(F.lit("")), b=versions.severity_bucket(F.lit("low"))) == ("NONE", "LOW")


def test_kleene(spark):
    def expected(values, operator):
        if not values:
            return None
        decisive = operator == "OR"
        return decisive if decisive in values else None if None in values else not decisive

    cases = [list(v) for n in range(4) for v in itertools.product([True, False, None], repeat=n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v array<boolean>")
    for op in ("AND", "OR"):
        found = dict(df.select("i", logic.combine(F.col("v"), F.lit(op)).alias("x")).collect())
        assert found == {i: expected(v, op) for i, v in enumerate(cases)}
