"""Bucketed averages of measurements: latest buckets, ranges, and rollups joined with the raw tail.

Measurements are rows (id, device_id, metric, value, unit, event_time); rollups are rows
(device_id, metric, unit, bucket_start, value_avg, value_min, value_max, sample_count).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.functions.params import HistoryParams
from heliogrid.functions.timebucket import time_bucket

KEYS = ["device_id", "metric", "bucket"]


def _wanted(rows: DataFrame, device_id: str, metrics: list[str] | None) -> DataFrame:
    rows = rows.where(F.col("device_id") == device_id)
    return rows.where(F.col("metric").isin(metrics)) if metrics else rows


def last_buckets(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of the last ``limit`` distinct buckets; a null bucket counts first and then matches nothing."""
    top = rows.select("bucket").distinct().orderBy(F.col("bucket").desc_nulls_first()).limit(limit)
    return rows.join(top, "bucket", "left_semi")


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("bucket").desc_nulls_first(), "metric")


def averages(rows: DataFrame, stride: int) -> DataFrame:
    """Average value a device, metric, unit and bucket."""
    return rows.groupBy("device_id", "metric", "unit", time_bucket(F.col("event_time"), stride).alias("bucket")).agg(F.avg("value").alias("value"))


def latest(rows: DataFrame, device_id: str, metrics: list[str] | None = None, limit: int = 30) -> DataFrame:
    """One-minute averages of the device's last ``limit`` minutes.

    The minutes are found from the times alone; the oldest of them is a literal in the second read, so it skips the
    rest of the device's history at the scan.
    """
    rows = _wanted(rows, device_id, metrics)
    minutes = rows.select(time_bucket(F.col("event_time"), 60).alias("bucket")).distinct().orderBy(F.col("bucket").desc_nulls_first()).limit(limit)
    oldest = min((r["bucket"] for r in minutes.collect() if r["bucket"] is not None), default=None)
    since = F.lit(False) if oldest is None else F.col("event_time") >= F.lit(oldest).cast("timestamp_ntz")
    return in_order(averages(rows.where(since), 60))


def _bounds(params: HistoryParams, now: datetime) -> tuple[datetime, datetime]:
    return params.bounds or (now - timedelta(days=1), now)


def _between(at: Column, start: datetime, end: datetime) -> Column:
    return (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))


def raw_history(rows: DataFrame, device_id: str, params: HistoryParams, now: datetime) -> DataFrame:
    """Averages over [start, end); without bounds the last ``limit`` buckets of the day before ``now``."""
    start, end = _bounds(params, now)
    out = averages(_wanted(rows, device_id, params.metrics).where(_between(F.col("event_time"), start, end)), params.stride)
    return in_order(out if params.bounds else last_buckets(out, params.limit))


def route(params: HistoryParams) -> str:
    """Which table answers: raw, 5min or hourly."""
    if params.aggregate != "avg" or params.bucket_unit is None:
        return "raw"
    size = params.bucket_size or 1
    if params.bucket_unit in ("hour", "day") or size % 60 == 0:
        return "hourly"
    return "5min" if size % 5 == 0 else "raw"


def rollup_history(rollup: DataFrame, raw: DataFrame, last_id: int | None, device_id: str, params: HistoryParams, now: datetime) -> DataFrame:
    """Weighted averages of rollup rows and of raw rows past the watermark.

    The watermark is a literal, so both branches push their filters to the scan. No state (None): no raw rows.
    Rollup rows count by their bucket start; raw null values count as rows, as the rollups' counts don't.
    """
    start, end = _bounds(params, now)
    tail = _wanted(raw, device_id, params.metrics).where(_between(F.col("event_time"), start, end))
    tail = tail.where(F.col("id") > last_id) if last_id is not None else tail.where(F.lit(False))
    fresh = tail.groupBy("device_id", "metric", time_bucket(F.col("event_time"), params.stride).alias("bucket")).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), F.max("unit").alias("unit")
    )
    done = _wanted(rollup, device_id, params.metrics).where(_between(F.col("bucket_start"), start, end))
    done = done.select("device_id", "metric", time_bucket(F.col("bucket_start"), params.stride).alias("bucket"), (F.col("value_avg") * F.col("sample_count")).alias("total"), F.col("sample_count").cast("long").alias("n"), "unit")
    out = fresh.unionByName(done).groupBy(*KEYS).agg(F.max("unit").alias("unit"), F.try_divide(F.sum("total"), F.sum("n")).alias("value"))
    return in_order(out if params.bounds else last_buckets(out, params.limit))


def history(raw: DataFrame, rollups: dict[str, DataFrame], last_id: int | None, device_id: str, params: HistoryParams, now: datetime) -> DataFrame:
    table = route(params)
    if table == "raw":
        return raw_history(raw, device_id, params, now)
    return rollup_history(rollups[table], raw, last_id, device_id, params, now)


def snapshots(rows: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(device_id, bucket, measurements: metric -> (value, unit)), of some metrics; of two units of a metric the last in order stays."""
    rows = rows.where(F.col("metric").isin(metrics)) if metrics else rows
    last = rows.groupBy("device_id", "bucket", "metric").agg(F.max_by(F.struct("value", "unit"), F.coalesce("unit", F.lit(""))).alias("m"))
    pairs = F.sort_array(F.collect_list(F.struct("metric", "m")))
    return last.groupBy("device_id", "bucket").agg(F.map_from_entries(pairs).alias("measurements"))


def present(value: float | None, digits: int = 1) -> float | None:
    """Rounding of one presented number, by its exact binary value."""
    return None if value is None else round(value, digits)
