"""Sources, sinks, ELF protections and the streaming scan on files of their own."""

from __future__ import annotations

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from shalebed.operators import elf
from shalebed.sources import files, sinks
from shalebed.streaming.scan import run_scan


def image(kind=2, stack=6, relro=False, tags=(), symbols=(), interp=False, dynamic=True, machine=8) -> bytes:
    """A small 32-bit little-endian ELF without sections."""
    strings = b"\0" + b"\0".join(symbols) + b"\0"
    table = b"\0" * 16 + b"".join(struct.pack("<IIIBBH", strings.index(s), 0, 0, 0x12, 0, 0) for s in symbols)
    n = 2 + relro + interp + dynamic
    at = 52 + 32 * n
    entries = [*tags, *([(6, at), (5, at + len(table))] if symbols else []), (0, 0)]
    body = table + strings
    dyn = b"".join(struct.pack("<II", *t) for t in entries)
    size = at + len(body) + len(dyn)
    segments = [(1, 0, 0, size, 5), (elf.STACK, 0, 0, 0, stack)]
    segments += [(elf.RELRO, 0, 0, 0, 4)] * relro + [(elf.INTERP, 0, 0, 0, 4)] * interp + [(elf.DYNAMIC, at + len(body), at + len(body), len(dyn), 6)] * dynamic
    head = b"\x7fELF\x01\x01\x01" + b"\0" * 9 + struct.pack("<HHIIIIIHHHHHH", kind, machine, 1, 0, 52, 0, 0, 52, 32, n, 40, 0, 0)
    return head + b"".join(struct.pack("<IIIIIIII", t, o, v, v, s, s, f, 4) for t, o, v, s, f in segments) + body + dyn


def test_elf(spark):
    rows = [
        ("a", "x-root/bin/a", image(2, dynamic=False)),
        ("a", "x-root/bin/b", image(3, interp=True, relro=True, tags=[(24, 0)], symbols=[b"__stack_chk_fail"])),
        ("a", "x-root/lib/c", image(3, stack=7, relro=True, tags=[(14, 1)], symbols=[b"printf"], machine=40)),
        ("a", "x-root/lib/copy", image(3, stack=7, relro=True, tags=[(14, 1)], symbols=[b"printf"], machine=40)),
        ("a", "x-root/broken", b"\x7fELF\x01\x01"),
        ("a", "x-root/text", b"hello"),
        ("a", "outside/b", image(2)),
        ("b", "y-root-1/t", b"text"),
    ]
    inventory = spark.createDataFrame(rows, "firmware_id string, path string, content binary")
    found = {r.firmware_id: r.asDict() for r in elf.filesystem_features(inventory).collect()}
    a = found["a"]
    assert (a["unpacked_n_files"], a["unpacked_n_elf"], a["unpacked_n_elf_exec"], a["unpacked_n_elf_lib"], a["unpacked_n_elf_static"], a["fs_elf_malformed"]) == (6, 4, 2, 1, 1, 1)
    assert a["unpacked_prop_nx"] == pytest.approx(2 / 3) and a["unpacked_prop_pie"] == 0.5 and a["unpacked_prop_relro_full"] == pytest.approx(2 / 3)
    assert a["unpacked_prop_canary"] == 0.5 and a["fs_arch"] == 8
    assert found["b"]["unpacked_n_elf"] == 0 and found["b"]["unpacked_prop_nx"] is None
    assert {r.firmware_id: r.any_under_root for r in elf.inventory_summary(inventory).collect()} == {"a": True, "b": True}


def test_images(spark, tmp_path):
    (tmp_path / "v" / "m").mkdir(parents=True)
    for name, data in {"a.bin": b"x" * 10, "b.TXT": b"no", ".hidden": b"no", "c": b"Salted__y", "d.img": b"z"}.items():
        (tmp_path / "v" / "m" / name).write_bytes(data)
    found = {r.path.rsplit("/", 1)[1]: r for r in files.firmware_files(spark, str(tmp_path), max_bytes=4).collect()}
    assert set(found) == {"a.bin", "c", "d.img"}
    assert bytes(found["a.bin"].content) == b"xxxx" and found["a.bin"].truncated and found["a.bin"].file_size == 10
    assert {r.path[-5:] for r in files.firmware_files(spark, str(tmp_path), allowed=[".img"]).collect()} == {"d.img"}
    marked = files.firmware_files(spark, str(tmp_path)).select("path", elf.is_encrypted(F.col("content")).alias("e")).where("e").collect()
    assert len(marked) == 1


def test_cache(spark, tmp_path):
    good = {"schema_version": 4, "fetched_at": "t", "queries": [], "cpe_candidates": [], "evidence_state": "cve_encontrada", "vendor": "a", "model": "m", "cves": [{"id": "C1", "cvss_max": 9.0, "severity": "HIGH", "configurations": [{"nodes": []}]}]}
    (tmp_path / "cache.json").write_text(json.dumps({"a/m": good, "a/x": good | {"schema_version": 3, "evidence_state": "?"}, "a/y": good | {"cves": None, "fetched_at": " "}}))
    entries = files.read_cache(spark, str(tmp_path / "cache.json"))
    assert {r.key: r.problems for r in files.cache_violations(entries).collect()} == {"a/x": ["schema_version", "evidence_state"], "a/y": ["cves", "fetched_at"]}
    row = files.cached_cves(entries.where("key = 'a/m'")).first()
    assert (row.cve_id, row.score, json.loads(row.configurations)) == ("C1", 9.0, [{"nodes": []}])


def test_text_columns_stay_text(spark, tmp_path):
    (tmp_path / "f.csv").write_text("firmware_id,meta_version,x\na,1.10,2\n")
    assert files.read_text_columns(spark, str(tmp_path / "f.csv"), ["firmware_id", "meta_version"]).first() == ("a", "1.10")
    with pytest.raises(ValueError, match="missing"):
        files.read_text_columns(spark, str(tmp_path / "f.csv"), ["none"])
    with pytest.raises(ValueError):
        files.read_features(spark, "x.xlsx")
    with pytest.raises(ValueError):
        files.read_run(spark, str(tmp_path), "../x")


def test_findings_keep_order(spark, tmp_path):
    rows = [("a", "p", f"t{i}", "s", "c", "low", "urls", "1.0", i) for i in range(5)]
    df = spark.createDataFrame(rows, "firmware_id string, path string, type string, source string, context string, confidence string, detector string, detector_version string, at int")
    sinks.write_findings(df, str(tmp_path / "f.jsonl"), ["at"])
    good, bad = files.read_findings(spark, str(tmp_path / "f.jsonl"))
    assert [r.type for r in good.orderBy("line").collect()] == [f"t{i}" for i in range(5)] and bad.count() == 0
    (tmp_path / "g.jsonl").write_text('{"firmware_id":"a","detector":"urls"}\nbroken\n')
    good, bad = files.read_findings(spark, str(tmp_path / "g.jsonl"))
    assert good.count() == 1 and [r.bad for r in bad.collect()] == ["broken"]


def test_line_numbers(spark, tmp_path):
    """Numbers are those of the file, in however many blocks it is read."""
    rng = random.Random(2)
    lines = [f"{i} " + "x" * rng.choice([0, 5, 300]) if i % 11 else "" for i in range(1, 4001)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_bytes("\n".join(lines).encode())
    (tmp_path / "in" / "b.jsonl").write_bytes(("\r\n".join(lines[:500]) + "\r\n").encode())
    (tmp_path / "in" / "c.jsonl").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = files.numbered_lines(spark, str(tmp_path / "in"))
        assert found.rdd.getNumPartitions() > 1
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, expected in (("a", lines), ("b", lines[:500])):
        assert {r.line_no: r.value for r in rows if r.file.endswith(f"{name}.jsonl")} == dict(enumerate(expected, 1))
    assert len(rows) == 4500


def test_bad_lines_are_named(spark, tmp_path):
    good = '{"firmware_id":"a","detector":"d","line":7}'
    (tmp_path / "f.jsonl").write_text("\n".join([good, good, "", '{"firmware_id":', good, '{"firmware_id":"a"}']))
    found, bad = files.read_findings(spark, str(tmp_path / "f.jsonl"))
    assert sorted((r.line_no, r.line) for r in found.collect()) == [(1, 7), (2, 7), (5, 7)]
    assert sorted((r.line_no, r.bad) for r in bad.collect()) == [(3, ""), (4, '{"firmware_id":'), (6, '{"firmware_id":"a"}')]
    with pytest.raises(ValueError, match="f.jsonl:3"):
        files.check_findings(spark, str(tmp_path / "f.jsonl"))
    (tmp_path / "g.jsonl").write_text(good + "\n")
    assert files.check_findings(spark, str(tmp_path / "g.jsonl")).count() == 1


def test_provenance(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"firmware_id":"a","in_table":true,"aliases":[{"meta_path":"x","vendor":"v","model":"m"},{"meta_path":"y","vendor":" ","model":"m"}]}\n{"firmware_id":"b","in_table":false,"aliases":[]}\n')
    good, blank = files.read_provenance(spark, str(tmp_path / "p.jsonl"))
    assert [r.meta_path for r in good.collect()] == ["x"] and [r.meta_path for r in blank.collect()] == ["y"]


def test_publish(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    target = str(tmp_path / "run")
    sinks.publish({"t.parquet": df, "t.csv": df}, target, {"seed": 1})
    assert sinks.check_published(spark, target)["seed"] == 1
    with pytest.raises(FileExistsError):
        sinks.publish({"t.parquet": df}, target, {})
    sinks.publish({"t.parquet": df, "t.csv": df}, target, {"seed": 2}, overwrite=True)
    assert sinks.check_published(spark, target)["seed"] == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["run"]
    assert sinks.row_digest(df) == sinks.row_digest(df.orderBy(F.desc("i")).repartition(3)) != sinks.row_digest(df.limit(1))
    df.limit(1).write.mode("overwrite").parquet(f"{target}/t.parquet")
    with pytest.raises(ValueError, match="changed"):
        sinks.check_published(spark, target)
    sinks.write_report(spark.createDataFrame([("b", 0.5), ("a", 1 / 3)], "k string, v double"), str(tmp_path / "r.csv"), ["k"])
    text = "".join(p.read_text() for p in (tmp_path / "r.csv").glob("part-*.csv"))
    assert text.splitlines() == ["k,v", "a,0.333333", "b,0.500000"]
    assert len(sinks.run_id({"b": 1, "a": 2})) == 64 and sinks.run_id({"b": 1, "a": 2}) == sinks.run_id({"a": 2, "b": 1})


def test_stream(spark, tmp_path):
    schema = "key string, text string"
    for k, text in enumerate(["user guest", "see http://a.example"]):
        spark.createDataFrame([(str(k), text)], schema).write.parquet(str(tmp_path / "in" / f"p{k}"))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = run_scan(spark, source, "key", str(tmp_path / "out"), str(tmp_path / "state"))
    rows = {r.key: (r.has_debug_account, r.count_urls) for r in out.collect()}
    assert rows == {"0": (True, 0), "1": (False, 1)} and out.count() == 2
