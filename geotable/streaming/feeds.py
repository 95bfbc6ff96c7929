"""Features as streams: files as they arrive, windows over event time, running extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geotable.functions import bbox as B
from geotable.sources import binary


def read_stream(spark: SparkSession, path: str, rect: B.Rect | None = None, **options) -> DataFrame:
    """Features of binary files as they arrive in a directory."""
    binary.register(spark)
    r = spark.readStream.format("features")
    for k, v in options.items():
        r = r.option(k, v)
    if rect is not None:
        r = r.option("rect", ",".join(map(repr, map(float, rect))))
    return r.load(path)


def windowed_extent(stream: DataFrame, time: str, size: str, late: str, slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Count and extent per window of event time; rows later than `late` behind the newest are left out, and windows close by then."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window, *(by or [])).agg(F.count(F.lit(1)).alias("n"), *B.extent_columns("bbox"))


def sessions(stream: DataFrame, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Count and extent per session: rows of one key with no pause longer than `gap`."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *by).agg(F.count(F.lit(1)).alias("n"), *B.extent_columns("bbox"))


def event_time(text: Column | str) -> Column:
    """Timestamps from date-time attributes; null for text that is none."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take what is there into Parquet and stop; a later call goes on where this one ended."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
