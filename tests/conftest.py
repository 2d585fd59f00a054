import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return c


def plain(v):
    """Values of both engines in one form."""
    if v is None or isinstance(v, (bool, int, str)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return f"{float(v):.6g}"


def same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    a = sorted(tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    b = sorted(tuple(plain(v) for v in r) for r in relation.select(*(f'"{c}"' for c in columns)).fetchall())
    assert a == b
