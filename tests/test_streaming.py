from pyspark.sql import functions as F

from terravane.operators import stats
from terravane.sources import rasters
from terravane.streaming import regions

from .conftest import DATA


def test_running_statistics_end_at_the_batch_result(spark, tmp_path):
    pixels = rasters.banded_raster(spark, DATA)
    tiles = rasters.tile_regions(spark, DATA).cache()
    pixels.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pixels.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = regions.running_statistics(stream, tiles).writeStream.outputMode("complete").format("memory").queryName("so_far").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.region, r.band): (r.n, round(r.s, 6), round(r.ss, 6)) for r in spark.table("so_far").collect()}
    want = {(r.region, r.band): (r.n, round(r.s, 6), round(r.ss, 6)) for r in stats.sufficient(pixels, tiles).collect()}
    assert got == want


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(0, 0, 0, float(k), f"2024-01-01 00:{k:02d}:00") for k in range(0, 60, 2)]
    pixels = spark.createDataFrame(rows, "r long, c int, band int, v double, ts string").withColumn("ts", F.to_timestamp("ts"))
    pixels.coalesce(1).write.parquet(str(tmp_path / "in"))
    one = spark.createDataFrame([(0, 0, 7)], "r long, c int, region long")
    stream = spark.readStream.schema(pixels.schema).parquet(str(tmp_path / "in"))
    q = regions.write_parts(regions.windowed_statistics(stream, one), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert got and sum(r.n for r in got) < 30 and got[0].n == 3 and got[0].region == 7
