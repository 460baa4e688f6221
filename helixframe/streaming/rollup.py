"""Contact areas rolled up over event time as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators.contacts import KEY


def windowed_areas(stream: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """(start, keys, area, n): sums of area in tumbling windows; rows later than late are dropped once a window has closed.

    Works on a static DataFrame as well, where every row counts.
    """
    keys = KEY if keys is None else keys
    timed = stream.withWatermark(time_col, late) if stream.isStreaming else stream
    sums = timed.groupBy(F.window(time_col, window).alias("w"), *keys).agg(F.sum("area").alias("area"), F.count("*").alias("n"))
    return sums.select(F.col("w.start").alias("start"), *keys, "area", "n")


def write_windows(sums: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows to Parquet, exactly once, for what has arrived so far."""
    return sums.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
