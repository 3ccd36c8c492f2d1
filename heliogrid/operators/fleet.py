"""Liveness of a fleet from registries and raw messages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.functions.safe import percent

LIVE, OFFLINE = timedelta(minutes=15), timedelta(hours=24)


def last_seen(registry: DataFrame, messages: DataFrame, kind: str) -> DataFrame:
    """Every registered device with its last reading; devices never seen stay, with null."""
    seen = messages.where("event_time is not null").groupBy("device_id").agg(F.max("event_time").alias("last_reading_at"))
    return registry.select("device_id").where("device_id is not null").distinct().join(seen, "device_id", "left").withColumn("kind", F.lit(kind))


def status(fleets: list[DataFrame], now: datetime) -> DataFrame:
    """One row: counts by state and kind, the last reading of all, and availability in percent."""
    all_ = fleets[0]
    for f in fleets[1:]:
        all_ = all_.unionByName(f)
    at = lambda d: F.lit(now - d).cast("timestamp_ntz")
    seen = F.col("last_reading_at")
    one = all_.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(seen >= at(LIVE)).alias("live"),
        F.count_if((seen < at(LIVE)) & (seen >= at(OFFLINE))).alias("stale"),
        F.count_if(seen.isNull() | (seen < at(OFFLINE))).alias("offline"),
        F.count_if(F.col("kind") == "environmental").alias("environmental"),
        F.count_if(F.col("kind") == "meter").alias("meter"),
        F.max(seen).alias("latest_reading_at"),
    )
    return one.withColumn("availability", percent(F.col("live"), F.col("total")))
