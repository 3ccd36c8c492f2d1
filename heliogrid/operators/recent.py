"""The last minutes of every device, kept ready: a bounded list a device that merges like the rollups.

A device's entry is its last ``LIMIT`` one-minute buckets, each with the sum, count and unit of every metric, as an array sorted by
bucket. It is a mergeable aggregate: ``build`` makes entries of measurements, ``merge`` joins two sets of them and cuts each device to its last
buckets again, so entries of batches by id add up to those of all rows as long as late rows aren't older than a device's oldest kept
bucket (rows that are older belong to no last minutes). ``latest`` answers from the entries and the raw rows past their watermark, whatever
the length of a device's history.

A device with very many rows is summed by (minute, metric) in every task before its minutes meet; what meets is at most ``LIMIT`` buckets from each
batch. Null times make no bucket; null values count as rows of their bucket without a value, as averages over raw rows have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.functions.timebucket import time_bucket
from heliogrid.operators.history import in_order

LIMIT = 100
MINUTE = 60
_CELL = ["metric", "unit", "total", "n"]


def _minutes(rows: DataFrame) -> DataFrame:
    """(device_id, bucket, cells): sums of each minute by metric and unit."""
    sums = rows.where("event_time is not null").groupBy("device_id", time_bucket(F.col("event_time"), MINUTE).alias("bucket"), "metric", "unit").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    return sums.groupBy("device_id", "bucket").agg(F.collect_list(F.struct(*_CELL)).alias("cells"))


def _kept(minutes: DataFrame, limit: int) -> DataFrame:
    """Of each device the last ``limit`` minutes, as one sorted array."""
    # cut by rank first, in a window that Spark limits within each task, so no more than these come together
    last = F.row_number().over(Window.partitionBy("device_id").orderBy(F.col("bucket").desc()))
    some = minutes.withColumn("_rank", last).where(F.col("_rank") <= limit)
    return some.groupBy("device_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "cells")), False).alias("minutes"))


def build(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(device_id, minutes) of measurements."""
    return _kept(_minutes(rows), limit)


def _cells(entries: DataFrame) -> DataFrame:
    """(device_id, bucket, metric, unit, total, n) of entries."""
    one = entries.select("device_id", F.explode("minutes").alias("m")).select("device_id", "m.bucket", F.explode("m.cells").alias("c"))
    return one.select("device_id", "bucket", *[f"c.{c}" for c in _CELL])


def merge(current: DataFrame, batch: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Entries of both, each device cut to its last ``limit`` minutes again."""
    both = _cells(current).unionByName(_cells(batch)).groupBy("device_id", "bucket", "metric", "unit").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return _kept(both.groupBy("device_id", "bucket").agg(F.collect_list(F.struct(*_CELL)).alias("cells")), limit)


def latest(entries: DataFrame, raw: DataFrame, last_id: int, device_id: str, metrics: list[str] | None = None, limit: int = 30) -> DataFrame:
    """One-minute averages of the device's last ``limit`` minutes, from its entry and the raw rows past the watermark ``last_id``.

    With ``metrics`` minutes without any of them don't count, so fewer than ``limit`` may be kept of them.
    """
    one = F.col("device_id") == device_id
    tail = build(raw.where(one & (F.col("id") > last_id)), limit)
    cells = _cells(entries.where(one)).unionByName(_cells(tail))
    cells = cells.where(F.col("metric").isin(metrics)) if metrics else cells
    out = cells.groupBy("device_id", "metric", "unit", "bucket").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("value"))
    top = out.select("bucket").distinct().orderBy(F.desc("bucket")).limit(limit)
    return in_order(out.join(top, "bucket", "left_semi").select("device_id", "metric", "unit", "bucket", "value"))
