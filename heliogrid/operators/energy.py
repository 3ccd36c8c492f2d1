"""Hourly energy from counters and from three-phase power; listings and sums of energy windows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.functions.rounding import round_exact
from heliogrid.functions.timebucket import time_bucket, working_flags
from heliogrid.operators.upsert import replace_by_key

#: Device id prefixes of the two meter kinds, and the power metric of each phase.
PREFIXES = {"plug": "shellyplug", "three_phase": "shellypro3em"}
PHASES = {"a": "a_act_power", "b": "b_act_power", "c": "c_act_power"}


def device_type(device_id: Column) -> Column:
    """plug, three_phase or null."""
    out = F.lit(None).cast("string")
    for name, prefix in PREFIXES.items():
        out = F.when(device_id.startswith(prefix), name).otherwise(out)
    return out


def split_devices(ids: list[str]) -> dict[str, list[str]]:
    """Ids by meter kind; an id of neither kind is an error."""
    out = {k: [i for i in ids if i.startswith(p)] for k, p in PREFIXES.items()}
    if odd := [i for i in ids if not any(i in x for x in out.values())]:
        raise ValueError(f"unknown device type: {odd}")
    return out


def with_window(rows: DataFrame, stride: int = 3600, zone: str | None = None) -> DataFrame:
    """window_end and the working flags of window_start."""
    day, hour = working_flags(F.col("window_start"), *([zone] if zone else []))
    end = F.timestamp_add("SECOND", F.lit(stride), F.col("window_start"))
    return rows.withColumns({"window_end": end, "is_working_day": day, "is_working_hour": hour})


def counter_delta(rows: DataFrame, stride: int = 3600) -> DataFrame:
    """Last minus first counter value a device and window, rounded to 3; negative deltas (resets) are dropped.

    Null values don't count; equal times are ordered by id. One sample gives 0.
    """
    at = F.struct("event_time", "id")
    out = (
        rows.where("value is not null and event_time is not null")
        .groupBy("device_id", time_bucket(F.col("event_time"), stride).alias("window_start"))
        .agg((F.max_by("value", at) - F.min_by("value", at)).alias("delta"))
    )
    return with_window(out.where("delta >= 0").select("device_id", "window_start", round_exact(F.col("delta")).alias("energy_wh")), stride)


def phase_energy(rows: DataFrame, phases: dict[str, str] = PHASES, stride: int = 3600) -> DataFrame:
    """Trapezoids over adjacent distinct times of any phase within a window, a phase missing at either end adding nothing.

    Windows with fewer than two distinct times give no row. Of equal (time, phase) the greatest id stays.
    """
    window = time_bucket(F.col("event_time"), stride).alias("window_start")
    rows = rows.where(F.col("metric").isin(list(phases.values())) & F.col("event_time").isNotNull())
    wide = rows.groupBy("device_id", window, "event_time").agg(
        *[F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("id"))).alias(p) for p, m in phases.items()]
    )
    w = Window.partitionBy("device_id", "window_start").orderBy("event_time")
    hours = F.timestamp_diff("MICROSECOND", F.lag("event_time").over(w), F.col("event_time")) / F.lit(3.6e9)
    parts = {f"{p}_part": (F.col(p) + F.lag(p).over(w)) / 2 * hours for p in phases}
    sums = wide.withColumns(parts).groupBy("device_id", "window_start").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"{p}_part"), F.lit(0.0)).alias(p) for p in phases])
    total = sum((F.col(p) for p in phases), F.lit(0.0))
    out = sums.where("n >= 2").select("device_id", "window_start", *[round_exact(F.col(p)).alias(f"{p}_energy_wh") for p in phases], round_exact(total).alias("total_energy_wh"))
    return with_window(out, stride)


def select_windows(rows: DataFrame, start: datetime, end: datetime, devices: list[str] | None = None, working_only: bool = False) -> DataFrame:
    """Windows wholly inside [start, end]."""
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    rows = rows.where((F.col("window_start") >= lit(start)) & (F.col("window_end") <= lit(end)))
    if devices is not None:
        rows = rows.where(F.col("device_id").isin(devices))
    return rows.where("is_working_day = 1 and is_working_hour = 1") if working_only else rows


def listing(plug: DataFrame, three_phase: DataFrame, start: datetime, end: datetime, devices: list[str] | None = None, working_only: bool = False) -> DataFrame:
    """Plug windows, then three-phase windows; newest first, then by device."""
    kinds = [(plug, "plug", 0), (three_phase, "three_phase", 1)]
    both = [select_windows(x, start, end, devices, working_only).withColumns({"device_type": F.lit(k), "_rank": F.lit(r)}) for x, k, r in kinds]
    out = both[0].unionByName(both[1], allowMissingColumns=True)
    return out.orderBy("_rank", F.desc("window_start"), "device_id").drop("_rank")


def totals(rows: DataFrame, columns: list[str], per_device: bool = True) -> DataFrame:
    """Sums of energy columns a device, or over all (then always one row, zeros if there is nothing)."""
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns]
    return rows.groupBy("device_id").agg(*sums) if per_device else rows.agg(*sums)


#: Keys of a stored energy window.
WINDOW = ["device_id", "window_start", "window_end"]
PHASE_COLUMNS = ["a_energy_wh", "b_energy_wh", "c_energy_wh", "total_energy_wh"]


def refresh(current: DataFrame, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], now: datetime | None = None) -> DataFrame:
    """Stored windows with those that ``rows`` fill computed anew by ``compute`` and put in place of the old ones.

    ``rows`` are all samples of the windows in question, late ones included. A window that can't be computed any
    more (a reset counter, a single time) keeps its stored value. With ``now`` rows have a created_at: a new window's
    is ``now``, one that is replaced keeps its own.
    """
    fresh = compute(rows)
    if now is not None:
        born = current.select(*[F.col(k).alias(f"_{k}") for k in WINDOW], F.col("created_at").alias("_born"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in WINDOW]
        fresh = fresh.join(born, same, "left").withColumn("created_at", F.coalesce("_born", F.lit(now).cast("timestamp_ntz"))).select(*fresh.columns, "created_at")
    return replace_by_key(current, fresh, WINDOW)


def touched(fresh: DataFrame, stride: int = 3600) -> DataFrame:
    """(device_id, window_start, day) of the windows that new or late samples fall into."""
    start = time_bucket(F.col("event_time"), stride)
    rows = fresh.where("event_time is not null").select("device_id", start.alias("window_start"))
    return rows.distinct().withColumn("day", F.to_date("window_start"))


def recompute(samples: DataFrame, fresh: DataFrame, compute: Callable[[DataFrame], DataFrame], stride: int = 3600, day: str | None = None) -> DataFrame:
    """The windows that ``fresh`` samples touch, computed from all ``samples`` (which hold the fresh ones), and no others.

    Of the samples only those between the first and the last touched window are read, and where they are stored by ``day`` only the
    touched days: both reach the scan as literals. Windows longer than a day need samples without ``day``. The semi-join is on
    (device, window), so a device with very many samples is split by its windows.
    """
    windows = touched(fresh, stride)
    first, last, days = windows.agg(F.min("window_start"), F.max("window_start"), F.collect_set("day")).first()
    if first is None:
        return compute(samples.limit(0))
    end = last + timedelta(seconds=stride)
    some = samples.where((F.col("event_time") >= F.lit(first).cast("timestamp_ntz")) & (F.col("event_time") < F.lit(end).cast("timestamp_ntz")))
    if day is not None:
        some = some.where(F.col(day).isin(days))
    start = time_bucket(F.col("event_time"), stride)
    return compute(some.withColumn("window_start", start).join(windows.drop("day"), ["device_id", "window_start"], "left_semi").drop("window_start"))


def refresh_touched(current: DataFrame, samples: DataFrame, fresh: DataFrame, compute: Callable[[DataFrame], DataFrame], stride: int = 3600, day: str | None = None, now: datetime | None = None) -> DataFrame:
    """``refresh`` for the windows that ``fresh`` samples touch; all other stored windows stay as they are."""
    return refresh(current, samples, lambda rows: recompute(rows, fresh, compute, stride, day), now)


def listing_of(ids: list[str], plug: DataFrame, three_phase: DataFrame, start: datetime, end: datetime, working_only: bool = False) -> DataFrame:
    """``listing`` of the given devices; each kind is read for its own devices only."""
    kinds = split_devices(ids)
    plug, three_phase = (x.where(F.col("device_id").isin(kinds[k])) if kinds[k] else x.limit(0) for x, k in ((plug, "plug"), (three_phase, "three_phase")))
    return listing(plug, three_phase, start, end, working_only=working_only)


def totals_of(ids: list[str], plug: DataFrame, three_phase: DataFrame, start: datetime, end: datetime, working_only: bool = False) -> DataFrame:
    """A row for every given device, in order of the ids: its kind and the sums of its kind's columns, zeros if there is nothing."""
    spark = plug.sparkSession
    split_devices(ids)
    wanted = spark.createDataFrame(list(enumerate(ids)), "_n int, device_id string").withColumn("device_type", device_type(F.col("device_id")))
    rows = listing_of(ids, plug, three_phase, start, end, working_only)
    sums = rows.groupBy("device_id").agg(*[F.sum(c).alias(c) for c in ("energy_wh", *PHASE_COLUMNS)])
    zero = lambda c, kind: F.when(F.col("device_type") == kind, F.round(F.coalesce(c, F.lit(0.0)), 3)).alias(c)
    out = wanted.join(sums, "device_id", "left").orderBy("_n")
    return out.select("device_id", "device_type", zero("energy_wh", "plug"), *[zero(c, "three_phase") for c in PHASE_COLUMNS])
