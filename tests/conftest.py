import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle(data):
    """DuckDB over the same tables."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{name}')")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect())


def _plain(v):
    if v is None:
        return ""
    return v.isoformat() if hasattr(v, "isoformat") else repr(v) if isinstance(v, float) else str(v)


def sql_rows(con, text):
    got = con.execute(text)
    names = [d[0] for d in got.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(tuple(_plain(r[i]) for i in at) for r in got.fetchall())
