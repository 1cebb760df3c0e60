import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture
def same(spark, duck):
    """Asserts that a query and its SQL give the same rows."""

    def check(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        at = [columns.index(c) for c in names]
        assert got == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())

    return check
