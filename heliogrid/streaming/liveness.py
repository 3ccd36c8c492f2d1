"""Liveness of devices as it changes: a state and a timer for each block of devices.

A device is live once a reading of it comes in. When the clock is ``LIVE`` past its last reading, without another one, it becomes
stale, and at ``OFFLINE`` past it offline: a timer fires, no message is needed. The clock is the stream's
watermark, the latest reading of any device less the delay allowed for late ones.

A change is (device_id, status, at, last_reading_at), with ``at`` the time at which it happened and not that at which it was noticed. Where
a batch holds a gap between two readings of a device, its changes in between are given as well, so the changes of readings in order don't
depend on how they fall into batches. A reading older than the last one changes nothing; a null time or device is no reading.

Readings are summed up to runs without a gap, (device, first and last time), by each task before they are dealt to the devices' states, so a
device with very many readings sends few rows. Devices are dealt to ``BLOCKS`` blocks by their hash; the devices of a block share a timer, the earliest of
theirs, and are handled together as columns, as a call of the state store and a data frame for each device cost more than all else. A checkpoint is tied to the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heliogrid.operators.fleet import LIVE, OFFLINE
from heliogrid.session import ship_package

CHANGES = "device_id string, status string, at timestamp, last_reading_at timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = timedelta(0)
BLOCKS = 1024
STATUS = ["live", "stale", "offline"]
NEVER = np.iinfo(np.int64).min


def _micros(d: timedelta) -> int:
    return d // timedelta(microseconds=1)


class Liveness(StatefulProcessor):
    """State: last reading and status of each device of the block. Rows: runs of readings without a gap of ``live``.

    A status is its place in STATUS, and -1 for a device that wasn't seen yet.
    """

    def __init__(self, live: timedelta, offline: timedelta):
        self.live, self.offline = _micros(live), _micros(offline)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("last", "device_id string, last long, status int")

    def _held(self) -> pd.DataFrame:
        rows = [tuple(r) for r in self.state.get()] if self.state.exists() else []
        return pd.DataFrame(rows, columns=["device_id", "last", "status"]).astype({"device_id": object, "last": np.int64, "status": np.int64})

    def _hold(self, names, last: np.ndarray, status: np.ndarray) -> None:
        """Store the block's devices and set its timer to the first change that time alone will make."""
        self.state.put(list(zip(list(names), last.tolist(), status.tolist(), strict=True)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        due = np.where(status == 0, last + self.live, last + self.offline)[status < 2]
        if due.size:
            self.handle.registerTimer(int(due.min()) // 1000 + 1)  # the clock has to be past it

    def _fade(self, last: np.ndarray, status: np.ndarray, upto: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Which devices without a reading from ``last`` to ``upto`` become stale and which offline."""
        stale = (status == 0) & (last + self.live < upto)
        return stale, (stale | (status == 1)) & (last + self.offline < upto)

    def _changes(self, names: np.ndarray, last: np.ndarray, stale: np.ndarray, offline: np.ndarray, live: np.ndarray, first: np.ndarray) -> pd.DataFrame:
        at = np.concatenate([last[stale] + self.live, last[offline] + self.offline, first[live]])
        seen = np.concatenate([last[stale], last[offline], first[live]])
        time = lambda t: pd.to_datetime(t, unit="us", utc=True).as_unit("us")
        status = np.repeat(np.array(STATUS, dtype=object)[[1, 2, 0]], [stale.sum(), offline.sum(), live.sum()])
        return pd.DataFrame({"device_id": np.concatenate([names[stale], names[offline], names[live]]), "status": status, "at": time(at), "last_reading_at": time(seen)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        runs = pd.concat([pdf[["device_id", "first", "last"]] for pdf in rows], ignore_index=True)
        code, names = pd.factorize(np.concatenate([held["device_id"].to_numpy(dtype=object), runs["device_id"].to_numpy(dtype=object)]))
        was = np.full(len(names), -1)
        was[code[: len(held)]] = held["status"]
        first = np.concatenate([np.full(len(held), NEVER), runs["first"].to_numpy(np.int64)])
        end = np.concatenate([held["last"].to_numpy(), runs["last"].to_numpy(np.int64)])
        order = np.lexsort((end, first, code))  # what is held comes first of a device
        code, first, end, run = code[order], first[order], end[order], order >= len(held)
        top = pd.Series(end).groupby(code).cummax().to_numpy()
        opens = np.r_[True, code[1:] != code[:-1]]
        last = np.where(opens, NEVER, np.r_[NEVER, top[:-1]])
        new = run & (end > last)  # older readings change nothing
        before = np.cumsum(new) - new
        before -= before[opens][code]  # codes are 0, 1, ... in order
        status = np.where(before > 0, 0, was[code])  # live since the batch's first new run
        code, first, end, last, status = code[new], first[new], end[new], last[new], status[new]
        first = np.where((status > 0) & (first <= last), end, first)  # late readings that bridge the gap: live again with the one that is new for certain
        stale, offline = self._fade(last, status, first)
        live = (status != 0) | stale
        now = was.copy()
        now[code] = 0
        ends = np.flatnonzero(np.r_[opens[1:], True])
        self._hold(names, top[ends], now)
        if live.any():
            yield self._changes(names[code], last, stale, offline, live, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        names, last, status = held["device_id"].to_numpy(dtype=object), held["last"].to_numpy(), held["status"].to_numpy()
        stale, offline = self._fade(last, status, timerValues.getCurrentWatermarkInMs() * 1000)
        self._hold(names, last, np.where(offline, 2, np.where(stale, 1, status)))
        if stale.any() or offline.any():
            yield self._changes(names, last, stale, offline, np.zeros(len(names), dtype=bool), last)

    def close(self) -> None:
        pass


def _runs(live: int):
    """Readings of each device in a batch as runs without a gap above ``live``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(["device_id", "t"])
            new = (pdf["device_id"] != pdf["device_id"].shift()) | (pdf["t"] - pdf["t"].shift() > live)
            one = pdf.groupby(new.cumsum()).agg(device_id=("device_id", "first"), first=("t", "first"), last=("t", "last"))
            one["at"] = pd.to_datetime(one["last"], unit="us", utc=True).dt.as_unit("us")
            yield one

    return run


def changes(readings: DataFrame, live: timedelta = LIVE, offline: timedelta = OFFLINE, late: timedelta = LATE) -> DataFrame:
    """Rows CHANGES of a stream of (device_id, event_time); ``late`` is how far behind the latest reading the clock goes."""
    spark = readings.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = readings.where("device_id is not null and event_time is not null")
    rows = rows.select("device_id", F.unix_micros(F.col("event_time").cast("timestamp")).alias("t"))
    runs = rows.mapInPandas(_runs(_micros(live)), "device_id string, first long, last long, at timestamp")
    runs = runs.withWatermark("at", f"{late // timedelta(milliseconds=1)} milliseconds")
    runs = runs.withColumn("block", F.pmod(F.hash("device_id"), F.lit(BLOCKS)))
    return runs.groupBy("block").transformWithStateInPandas(Liveness(live, offline), CHANGES, "Append", "EventTime")


def follow(readings: DataFrame, folder: str, checkpoint: str, **how: timedelta):
    """Append the changes to Parquet files, once each."""
    sink = changes(readings, **how).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return sink.outputMode("append").trigger(availableNow=True).start(folder)


def now(changed: DataFrame) -> DataFrame:
    """The last change of every device."""
    last = F.max_by(F.struct("status", "at", "last_reading_at"), F.struct("last_reading_at", "at")).alias("c")
    return changed.groupBy("device_id").agg(last).select("device_id", "c.*")


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(device_id, status, last_reading_at) of every device as the stream's state has them: a live device's last reading is no change of it, so the changes don't say it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    state = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS]), F.col("list_element.status") + 1)
    return state.select("list_element.device_id", status.alias("status"), F.timestamp_micros("list_element.last").cast("timestamp_ntz").alias("last_reading_at"))
