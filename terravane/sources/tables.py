"""Tables in the shared folder: the cut points of iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="terravane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/terravane-{spark.sparkContext.applicationId}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files as they end, which is right where their results are written or collected."""
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before)


def new_path(spark: SparkSession, label: str = "table") -> str:
    _written.append(f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def settle(df: DataFrame, label: str = "table", gather: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor repeats nothing before it.

    gather: deal the rows to parts of the session's advisory size first, for narrow results of wide scans, which else leave
    a tiny file for every task.
    """
    spark = df.sparkSession
    path, schema = new_path(spark, label), df.schema
    with freed_shuffles(spark):
        (df.hint("rebalance") if gather else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def written() -> list[str]:
    """Paths of this process' tables that have not been removed."""
    return list(_written)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that no result needs any more."""
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if name in _written:
            _written.remove(name)


def sweep(spark: SparkSession) -> None:
    """Remove all of this application's tables, once no result that reads them is needed any more."""
    remove(spark, [own_folder(spark)])
    _written.clear()


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
