"""Detectors on literal strings: hits, near misses and invariance."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shalebed.operators import detectors as D

CASES = {
    "hardcoded_passwords": [
        ("wpa_psk=12345678", 1), ("adminPassword=admin123", 1), ("password=%s", 0), ("password=${X}", 0), ("password={{x}}", 0), ("password=<x>", 0),
        ("password=NULL", 0), ("password=(null)", 0), ("password_length=8", 0), ("default login admin", 1), ("confirm password", 0), ("admin", 0),
        ("a=1; passwd: hunter2 & pwd=x", 1), ("PASSWD=abc", 1), ("mysecretkey=1", 0),
    ],
    "credential_pairs": [("admin:admin", 1), ("root:1234 guest:guest", 1), ("alice:1234", 0), ("ADMIN:Root", 1), ("xadmin:admin", 0)],
    "non_public_ips": [("host 10.0.0.1", 1), ("host 100.64.0.1", 1), ("host 192.0.0.9", 0), ("gw 192.168.1.1 and 172.16.0.1", 2), ("host 127.0.0.1", 0), ("host 224.0.0.1", 1)],
    "public_ips": [
        ("7.0.1.0", 0), ("ip 8.8.8.8.9", 0), ("dns server 8.8.8.8", 1), ("8.8.8.8:443", 1), ("https://8.8.8.8/", 0), ("https://8.8.8.8/ 9.9.9.9", 1),
        ("host 172.32.1.1", 1), ("version 8.8.8.8 host", 0), ("v 8.8.8.8 host", 0), ("Linux-8.8.8.8 host", 0), ("host 8.8.8.300", 0), ("host 08.8.8.8.", 1), ("host x8.8.8.8", 0),
    ],
    "telnetd": [("/usr/sbin/telnetd", 1), ("TELNETD", 0), ("telnetd telnetd", 1)],
    "debug_account": [("user guest", 1), ("guest book", 0), ("debug login test", 1)],
    "outdated_libssl": [("OpenSSL 1.0.2k", 1), ("openssl/1.1.1", 0), ("OpenSSL 1.1", 0)],
    "outdated_busybox": [("BusyBox v1.32.9", 1), ("BusyBox v1.33.0", 0), ("busybox_1.2.3", 1)],
    "outdated_dropbear": [("Dropbear v2022.81", 1), ("Dropbear SSH 2022.82", 0), ("dropbear 0.52", 1)],
    "urls": [("see HTTP://a/b and https://c'd", 2), ("ftp://x", 0)],
    "api_tokens": [
        ("id " + "0f" * 16, 1), ("id " + "abcde" + "0f" * 16, 0), ("x Ab3dEf7hIjKlA9NoPqRsTuVwXyZ1M5g0Qk8SbUcW2e4Yz== y", 1), ("z" * 60, 0), ("0f" * 15, 0),
    ],
    "crypto_signatures": [("AES S-Box", 1), ("private key", 1), ("paesx", 0)],
    "encrypted_sections": [("AES S-Box", 0), ("OpenSSL encryption", 1), ("cipher", 1)],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_counts(spark, name):
    detector = next(d for d in D.DETECTORS if d.name == name)
    rows = [(i, s) for i, (s, _) in enumerate(CASES[name])]
    found = dict(spark.createDataFrame(rows, "i int, s string").select("i", F.size(detector.build(F.col("s")))).collect())
    assert {CASES[name][i][0]: n for i, n in found.items()} == dict(CASES[name])


def test_every_detector_has_cases():
    assert set(CASES) == {d.name for d in D.DETECTORS}


def test_public_ranges(spark):
    import ipaddress
    import random

    rng = random.Random(1)
    addresses = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(3000)]
    addresses += [f"{a}" for lo, hi in D.NOT_GLOBAL for a in (lo, hi)] + ["192.0.0.9", "192.0.0.10", "100.63.255.255", "172.32.0.0"]
    rows = spark.createDataFrame([(a,) for a in addresses], "a string").select("a", D.is_public(F.col("a"))).collect()
    for a, public in rows:
        ip = ipaddress.IPv4Address(a)
        assert public == (ip.is_global and not ip.is_multicast), a


def test_empty_documents_have_zeros(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "key string")
    strings = spark.createDataFrame([("a", "user guest telnetd")], "key string, s string")
    for out in (D.scan_counts(strings, docs, "key"), D.reduce_findings(docs, D.find(strings, ["key"]), "key")):
        rows = {r.key: r.asDict() for r in out.collect()}
        assert rows["b"] == {"key": "b"} | {d.column: 0 if d.reduces == "count" else False for d in D.SCANNED}
        assert rows["a"]["has_telnetd"] and rows["a"]["has_debug_account"]


def test_order_and_partitions_dont_matter(spark, data):
    from shalebed.functions.strings import strings_of

    docs = spark.read.parquet(f"{data}/documents.parquet")
    one = D.scan_counts(strings_of(docs, "doc_id", F.col("text")), docs, "doc_id").collect()
    many = docs.repartition(7, "lang").orderBy(F.desc("n_chars"))
    assert sorted(one) == sorted(D.scan_counts(strings_of(many, "doc_id", F.col("text")), many, "doc_id").collect())


def test_signatures(spark):
    lines = ["0  0x0  Squashfs filesystem", "DECIMAL  HEX  DESCRIPTION", "9  0x9  JFFS2 filesystem, lzma", "12 0xC Squashfs, gzip compressed"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k int, pos int, line string")
    described = rows.select("k", "pos", D.signature_text(F.col("line")).alias("description")).where("description IS NOT NULL")
    r = D.structural_features(described, "k").first()
    assert (r.n_filesystems, r.fs_type, r.compression_type, r.n_crypto_signatures, r.has_encrypted_sections) == (3, "squashfs", "lzma", 0, False)
    tie = spark.createDataFrame([(1, 0, "jffs2"), (1, 1, "ext4")], "k int, pos int, description string")
    assert D.structural_features(tie, "k").first().fs_type == "jffs2"


def test_ascending_runs(spark):
    import random
    import string

    rng = random.Random(3)
    alphabet = string.digits + string.ascii_letters + "+/="
    texts = ["".join(rng.choice(alphabet) for _ in range(12)) for _ in range(300)] + ["x01234y", "/0123", "abcdx", "WXYZ[", "vwxyz"]
    pattern = D.ascending_pattern(alphabet, 4)
    for t, a, b in spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.has_ascending_run(F.col("t"), 4), F.col("t").rlike(pattern)).collect():
        expected = any(all(ord(t[i + k]) == ord(t[i]) + k for k in range(4)) for i in range(len(t) - 3))
        assert a == expected == b


def test_findings_of_some_fields(spark):
    texts = ["password=abc", "login admin", "x=1 host 8.8.8.8 and 10.0.0.1", "/usr/sbin/telnetd", "PASSWORD: %s pwd=q", "root:toor", "plain"]
    strings = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "k long, s string")
    whole = [tuple(r) for r in D.find(strings, ["k"]).select("k", "detector", "source").collect()]
    few = D.find(strings, ["k"], fields=["detector", "source"])
    assert few.columns == ["k", "detector", "source"] and sorted(map(tuple, few.collect())) == sorted(whole)
    assert {(0, "hardcoded_passwords"), (1, "hardcoded_passwords"), (2, "public_ips"), (2, "non_public_ips"), (4, "hardcoded_passwords")} <= {r[:2] for r in whole}
    # Rules of one detector aren't paid for by a query of others.
    plan = D.find(strings, ["k"], detectors=[d for d in D.DETECTORS if d.name == "telnetd"], fields=["detector"])._jdf.queryExecution().toString()
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()


def test_words_anywhere(spark):
    texts = ["User", "pass", "PWD", "no", "", "xdefaultx", "lo gin"]
    strings = spark.createDataFrame([(s,) for s in texts], "s string")
    assert [r[0] for r in strings.select(D.has_any(F.col("s"), ["user", "pass", "pwd", "default", "login"])).collect()] == [True, True, True, False, False, True, False]
