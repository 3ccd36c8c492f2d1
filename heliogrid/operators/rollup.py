"""Mergeable rollups of measurements, kept current by an ingestion-id watermark; retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.functions.timebucket import time_bucket
from heliogrid.operators.upsert import replace_by_key

KEYS = ["device_id", "metric", "bucket_start"]
STRIDES = {"5min": 300, "hourly": 3600}


def build(rows: DataFrame, stride: int, by_unit: bool = False, drop_nulls: bool = True) -> DataFrame:
    """Rollup rows of measurements; null values and times don't count. ``by_unit``: unit is part of the key."""
    if drop_nulls:
        rows = rows.where("value is not null and event_time is not null")
    unit = ["unit"] if by_unit else []
    return rows.groupBy("device_id", "metric", *unit, time_bucket(F.col("event_time"), stride).alias("bucket_start")).agg(
        *([] if by_unit else [F.max("unit").alias("unit")]),
        F.avg("value").alias("value_avg"),
        F.min("value").alias("value_min"),
        F.max("value").alias("value_max"),
        F.count(F.lit(1)).cast("int").alias("sample_count"),
    )


def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Additive merge: weighted average, extremes, summed counts; the batch's unit wins if it has one."""
    both = current.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    n = F.sum("sample_count")
    return both.groupBy(*KEYS).agg(
        F.max_by("unit", F.when(F.col("unit").isNotNull(), F.col("_new"))).alias("unit"),
        F.try_divide(F.sum(F.col("value_avg") * F.col("sample_count")), n).alias("value_avg"),
        F.min("value_min").alias("value_min"),
        F.max("value_max").alias("value_max"),
        n.cast("int").alias("sample_count"),
    )


def next_batch(rows: DataFrame, last_id: int | None, size: int) -> DataFrame:
    """The next ``size`` rows past the watermark, by id. Without a state row the job must not run."""
    if last_id is None:
        raise ValueError("rollup state is missing: seed it first")
    return rows.where(F.col("id") > last_id).orderBy("id").limit(size)


def advance(batch: DataFrame, last_id: int) -> int:
    """The watermark after ``batch``: its greatest id, or the old one if it is empty."""
    return batch.agg(F.coalesce(F.max("id"), F.lit(last_id)).alias("id")).first()["id"]


def batch_stats(batch: DataFrame) -> DataFrame:
    return batch.agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def seed(current: DataFrame, rows: DataFrame, stride: int, now: datetime, lookback: timedelta = timedelta(days=2), aligned: bool = True) -> DataFrame:
    """Rebuild the buckets since ``now - lookback`` and put them in place of the old ones.

    ``aligned`` takes the whole oldest bucket; without it that bucket is rebuilt from its rest only.
    """
    since = F.lit(now - lookback).cast("timestamp_ntz")
    since = time_bucket(since, stride) if aligned else since
    return replace_by_key(current, build(rows.where(F.col("event_time") >= since), stride), KEYS)


def state_lag(rows: DataFrame, last_id: int) -> DataFrame:
    """Watermark, greatest id and the distance between them."""
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("max_id"))
    return top.select(F.lit(last_id).cast("long").alias("last_measurement_id"), "max_id", (F.col("max_id") - last_id).alias("lag"))


def doomed(rows: DataFrame, last_id: int | None, now: datetime, keep: timedelta, size: int) -> DataFrame:
    """The oldest ``size`` ids that are past retention and already rolled up; null times stay."""
    if last_id is None:
        raise ValueError("rollup state is missing: seed it first")
    old = F.col("event_time") < F.lit(now - keep).cast("timestamp_ntz")
    return rows.where(old & (F.col("id") <= last_id)).orderBy("id").limit(size)


def survivors(rows: DataFrame, last_id: int | None, now: datetime, keep: timedelta, size: int) -> DataFrame:
    """What stays once the ``doomed`` rows are gone.

    Those are all rows past retention up to some id, so that id is all that has to be known: a filter, no join.
    """
    top = doomed(rows.select("id", "event_time"), last_id, now, keep, size).agg(F.max("id")).first()[0]
    if top is None:
        return rows
    old = F.coalesce(F.col("event_time") < F.lit(now - keep).cast("timestamp_ntz"), F.lit(False))
    return rows.where(~(old & (F.col("id") <= top)) | F.col("id").isNull())


def expire(rows: DataFrame, now: datetime, keep: timedelta) -> DataFrame:
    """Rows younger than ``keep``, and those without a time."""
    return rows.where(F.col("event_time").isNull() | (F.col("event_time") >= F.lit(now - keep).cast("timestamp_ntz")))
