"""Region statistics over streams of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_statistics(pixels: DataFrame, pixel_region: DataFrame) -> DataFrame:
    """(region, band, n, s, ss) so far of a stream of pixels (r, c, band, v): sums that new pixels only add to."""
    v = F.col("v")
    return pixels.join(pixel_region, ["r", "c"]).groupBy("region", "band").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def windowed_statistics(pixels: DataFrame, pixel_region: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """The same by windows of event time ``ts``; pixels later than the watermark are left out and closed windows are emitted once."""
    v = F.col("v")
    rows = pixels.withWatermark("ts", late).join(pixel_region, ["r", "c"])
    return rows.groupBy(F.window("ts", width), "region", "band").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")).select("window.start", "region", "band", "n", "s", "ss")


def write_parts(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows as Parquet; files and offsets commit together, so a restart repeats no window."""
    return stats.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
