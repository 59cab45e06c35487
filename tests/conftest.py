import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def same_rows(df, relation):
    """Equal names and equal rows in any order."""
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(c) for c in names]
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    want = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
