"""Every registered query against its SQL, or against what must hold of its result."""

from __future__ import annotations

import pytest

from shalebed import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(same_as_sql, name):
    rows = same_as_sql(catalog.QUERIES[name], catalog.SQL[name])
    assert rows


def test_contract(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_folds(spark, data):
    rows = catalog.QUERIES["q_folds"](spark, data).collect()
    tests = [r for r in rows if r.role == "test"]
    assert len({r.o_orderkey for r in rows}) == len(tests)
    assert {r.fold for r in tests} == set(range(5))
    assert len({(r.group, r.fold) for r in tests}) == len({r.group for r in tests})


def test_allocate(spark, data):
    rows = catalog.QUERIES["q_allocate"](spark, data).collect()
    assert sum(r.quota for r in rows) == min(150, sum(r.capacity for r in rows))


def test_models(spark, data):
    rows = {r.arm: r for r in catalog.QUERIES["q_out_of_fold_metrics"](spark, data).collect()}
    assert rows["forest"].n == rows["majority"].n > 50
    assert rows["forest"].macro_f1 > rows["majority"].macro_f1


def test_bootstrap_drawn(spark, data):
    r = catalog.QUERIES["q_bootstrap_drawn"](spark, data).first()
    assert r.delta_low <= r.delta <= r.delta_high and abs(r.first - r.second - r.delta) < 1e-12


def test_compress_ratio(spark, data):
    import zlib

    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in catalog.QUERIES["q_compress_ratio"](spark, data).collect():
        assert r.compress_ratio == pytest.approx(len(zlib.compress(texts[r.doc_id], 9)) / len(texts[r.doc_id]))
