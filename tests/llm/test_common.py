import glob

from terravane.llm import common
from terravane.sources import tables


def test_sweep_removes_the_tables(spark):
    df = common.stash(spark.range(5), "five")
    where = tables.own_folder(spark).removeprefix("file://")
    assert df.count() == 5 and glob.glob(f"{where}/five-*")
    kept = tables.shared_folder(spark)
    common.sweep(spark)
    assert not glob.glob(f"{where}/*") and tables.shared_folder(spark) == kept
