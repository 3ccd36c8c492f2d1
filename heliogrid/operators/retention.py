"""Retention of measurements stored by day: whole days go, days with rows on both sides of the bound are written anew, others aren't touched.

The days' folders are ``day=YYYY-MM-DD`` under one path. Rows that go are those of ``rollup.doomed`` (bounded, behind the watermark) or all
past retention. Rows that stay in a mixed day are written beside the table first and then put in place by a dynamic partition overwrite,
so a job that dies leaves every row at least once, and its repetition finishes the work. One writer a table.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "id long, device_id string, metric string, value double, unit string, event_time timestamp_ntz, day date"


def store(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write measurements by day; a null time goes to a day of its own. One file a task and day at most: rows are dealt by day and device."""
    dated = rows.withColumn("day", F.to_date("event_time"))
    dated.repartition("day", F.pmod(F.xxhash64("device_id"), F.lit(8))).write.partitionBy("day").mode(mode).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(path)


def purge(spark: SparkSession, path: str, now: datetime, keep: timedelta, last_id: int | None = None, size: int | None = None) -> dict[str, list[str]]:
    """Delete rows past retention; the days that were dropped and those that were written anew.

    With ``size`` the oldest so many ids up to the watermark ``last_id`` only, as a job that goes on in steps would; without, all.
    """
    rows = stored(spark, path)
    bound = now - keep
    old = (F.col("event_time") < F.lit(bound).cast("timestamp_ntz")) & (F.col("day") <= F.lit(bound.date()))  # the day prunes folders
    gone: Column = old
    if size is not None:
        if last_id is None:
            raise ValueError("rollup state is missing: seed it first")
        # the bounded delete takes all old rows up to some id, so one number says which
        few = rows.where(old & (F.col("id") <= last_id)).select("id").orderBy("id").limit(size)
        top = few.agg(F.max("id")).first()[0]
        if top is None:
            return {"dropped": [], "rewritten": []}
        gone = old & (F.col("id") <= top)
    marked = rows.where(F.col("day") <= F.lit(bound.date())).groupBy("day").agg(F.count_if(gone).alias("gone"), F.count(F.lit(1)).alias("all"))
    days = marked.where("gone > 0").collect()  # a row a day
    dropped = sorted(str(r["day"]) for r in days if r["gone"] == r["all"])
    mixed = sorted(r["day"] for r in days if r["gone"] < r["all"])
    if mixed:
        beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
        rows.where(F.col("day").isin(mixed) & ~F.coalesce(gone, F.lit(False))).write.parquet(beside)
        kept = spark.read.schema(ROWS).parquet(beside).repartition("day")
        kept.write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        _delete(spark, beside)
    for day in dropped:
        _delete(spark, f"{path}/day={day}")
    return {"dropped": dropped, "rewritten": [str(d) for d in mixed]}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
