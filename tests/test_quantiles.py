"""Exact quantiles of groups against NumPy."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from shalebed.operators.quantiles import quantiles

WANTED = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


def test_quantiles(spark):
    rng = random.Random(3)
    groups = {("hot", 1): [rng.gauss(0, 1) for _ in range(4000)], ("ties", 1): [float(rng.randrange(3)) for _ in range(999)], ("ties", 2): [5.0], (None, None): [1.0, 2.0], ("two", None): [-0.0, 0.0, -1.5]}
    rows = [(a, b, v) for (a, b), values in groups.items() for v in values] + [("hot", 1, None), ("empty", 3, None), ("nan", 1, float("nan")), ("nan", 1, 1.0), ("nan", 1, 2.0)]
    df = spark.createDataFrame(rows, "a string, b int, value double").repartition(5).withColumn("n", F.lit(1))
    found = {(r.a, r.b): r.q for r in quantiles(df, ["a", "b"], "value", "n", WANTED).collect()}
    nan = found.pop(("nan", 1))
    assert nan[3] == 2.0 and nan[0] == 1.0 and np.isnan(nan[-1])
    assert found.keys() == groups.keys()
    for key, values in groups.items():
        assert np.allclose(found[key], np.percentile(values, [100 * q for q in WANTED]), rtol=0, atol=1e-12), key


def test_counted_values(spark):
    df = spark.createDataFrame([("g", 1, 1_000_000_000), ("g", 2, 1), ("g", 3, 999_999_999), ("g", 3, 1)], "k string, value int, n long")
    assert quantiles(df, ["k"], "value", "n", [0.25, 0.5, 0.75]).first().q == [1.0, 2.0, 3.0]
    assert quantiles(df.where("false"), ["k"], "value", "n", [0.5]).count() == 0
    assert quantiles(df, [], "value", "n", [1.0]).first().q == [3.0]
