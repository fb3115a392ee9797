from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rounded(rows):
    """Rows as sortable tuples of text, doubles to six places."""
    return sorted(tuple(format(round(x, 6) + 0.0, ".6f") if isinstance(x, float) else repr(x) for x in row) for row in rows)


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Holds a query's rows against its SQL's rows, column by column name."""

    def run(query, sql):
        df = query(spark, SF)
        cols = sorted(df.columns)
        out = duck.sql(sql)
        assert sorted(out.columns) == cols
        want = duck.sql(f"select {', '.join(cols)} from ({sql}) q").fetchall()
        got = [tuple(r) for r in df.select(*cols).collect()]
        assert len(got) == len(want)
        assert rounded(got) == rounded(want)

    return run
