import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = Path(DATA, f"{name}.parquet")
        con.sql(f"create view {name} as select * from read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Runs a query and its SQL on the smallest tables and asserts equal rows and columns."""

    def plain(x):
        if isinstance(x, float):
            return round(x, 7) + 0.0
        return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x

    def check(query, sql):
        df, found = query(spark, DATA), duck.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(found.columns)
        at = [found.columns.index(c) for c in names]
        ours = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
        assert ours == theirs

    return check
