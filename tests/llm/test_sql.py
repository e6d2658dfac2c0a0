"""Queries whose results SQL can express, and the registration of all eleven."""

import pytest

from terravane.llm import queries, sql

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_same_as_sql(name, same):
    same(queries.queries()[name], sql.ORACLES[name])


def test_all_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", ["op3_quality", "op4_rules", "op7_ppm", "op10_order"])
def test_one_row_or_more_a_document(name, spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.queries()[name](spark, DATA)
    assert got.select("doc_id").distinct().count() == docs.count()
