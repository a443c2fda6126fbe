from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in sorted(Path(DATA).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    """Values of both engines as one text."""
    from decimal import Decimal

    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    if isinstance(value, Decimal):
        return str(int(value)) if value == int(value) else repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(normal, value)) + "]"
    return str(value)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    def check(query, sql):
        df = query(spark, DATA)
        columns = sorted(df.columns)
        ours = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        theirs = sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
        assert len(ours) == len(theirs)
        assert ours == theirs
        return ours

    return check


@pytest.fixture(scope="session")
def data():
    return DATA
