"""Every query against its SQL, and the properties of those that SQL does not express."""

import pytest

from terravane.plans import queries

from .conftest import DATA

WITH_SQL = sorted(queries.oracle_sql())
OTHERS = sorted(set(queries.queries()) - set(WITH_SQL))


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in OTHERS if n not in ("label_map_stack",)])
def test_runs(name, spark):
    assert queries.queries()[name](spark, DATA).count() > 0


def test_superpixels_are_a_partition(spark):
    rows = queries.slic_full(spark, DATA).collect()
    assert len({(x.r, x.c) for x in rows}) == len(rows) == 500 * 16
    assert min(sum(y.region == k for y in rows) for k in {x.region for x in rows}) >= 12


def test_hierarchy_nests(spark):
    nodes = {r.node: r for r in queries.hslic_full(spark, DATA).collect()}
    assert any(n.parent for n in nodes.values())
    assert all(n.parent is None or nodes[n.parent].scale > n.scale for n in nodes.values())


def test_label_stack_covers_all_atoms(spark):
    rows = queries.label_map_stack(spark, DATA).collect()
    assert {r.scale for r in rows} == {2.5, 3.5}
    assert len({(r.scale, r.atom) for r in rows}) == len(rows)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["region", "band", "moment", "value"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
