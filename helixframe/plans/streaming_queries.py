"""The roll-up over events; an extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.plans.registry import query
from helixframe.plans.tables import table
from helixframe.streaming.rollup import windowed_areas


@query("SELECT date_trunc('hour', ts) AS start, event_type, sum(value::decimal(20,6))::double AS area, count(*) AS n FROM events GROUP BY ALL")
def windowed_areas_hourly(spark, d):
    rows = table(spark, d, "events").select("ts", "event_type", F.col("value").cast("decimal(20,6)").alias("area"))
    return windowed_areas(rows, keys=["event_type"]).withColumn("area", F.col("area").cast("double"))
