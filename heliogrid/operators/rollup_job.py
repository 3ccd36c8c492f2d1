"""The rollup job: bounded batches by ingestion id, both rollups and the watermark in one commit.

A store holds the rollups by bucket day. A commit writes the days it touches into a folder of the new version,
then a manifest that says for every day in which version it is, with the watermark, and only then a pointer row. So
readers see both rollups and the watermark of one commit, a job that died in between is repeated from
the same watermark into the same folders, and days that a batch doesn't touch are not written again.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.functions.timebucket import time_bucket
from heliogrid.operators import rollup
from heliogrid.operators.upsert import VersionedTable, replace_by_key
from heliogrid.sources.landed import ROLLUP

BATCH = 500_000
_MANIFEST = "name string, day string, version long, last_id long"


class RollupStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = VersionedTable(spark, f"{self.path}/manifest")
        self._columns = [f.split()[0] for f in ROLLUP.split(", ")]

    def _manifest(self) -> list:
        return self.manifests.read(_MANIFEST).collect()  # a row a day and rollup

    def last_id(self) -> int | None:
        """The watermark; None before the store is seeded."""
        return next((r["last_id"] for r in self._manifest() if r["name"] == "state"), None)

    def table(self, name: str, days: list[str] | None = None, manifest: list | None = None) -> DataFrame:
        """One of the rollups, or some days of it."""
        rows = self._manifest() if manifest is None else manifest
        at = [f"{self.path}/data/v{r['version']}/{name}/day={r['day']}" for r in rows if r["name"] == name and (days is None or r["day"] in days)]
        return self.spark.read.schema(ROLLUP).parquet(*at) if at else self.spark.createDataFrame([], ROLLUP)

    def _write(self, rows: DataFrame, path: str) -> list[str]:
        """Write by bucket day, a file a day; the days."""
        dated = rows.select(*self._columns, F.date_format("bucket_start", "yyyy-MM-dd").alias("day"))
        dated.repartition("day").write.partitionBy("day").mode("overwrite").parquet(path)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [f.getPath().getName() for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        return sorted(n.removeprefix("day=") for n in names if n.startswith("day="))

    def commit(self, last_id: int, fresh: dict[str, DataFrame], put, batch: int = -1) -> int:
        """Put ``fresh`` rows of each rollup into the days that they touch, by ``put(current, fresh)``.

        The fresh rows are computed and written once; where they touch no day that is stored, that is all, else they are
        put together with these days only.
        """
        version = (self.manifests.version() or 0) + 1
        old = self.manifests.read(_MANIFEST, version - 1 or None).collect()
        rows = []
        for name, new in fresh.items():
            path = f"{self.path}/data/v{version}/{name}"
            stored = {r["day"] for r in old if r["name"] == name}
            days = self._write(new, path)
            if met := [d for d in days if d in stored]:
                aside = f"{self.path}/data/v{version}/_fresh_{name}"
                self._delete(aside)
                store, at, to = self._at(path, aside)
                store.rename(at, to)
                self._write(put(self.table(name, met, old), self.spark.read.schema(ROLLUP).parquet(aside)), path)
                self._delete(aside)
            rows += [(name, d, version, None) for d in days]
            rows += [(name, r["day"], r["version"], None) for r in old if r["name"] == name and r["day"] not in days]
        rows += [tuple(r) for r in old if r["name"] not in (*fresh, "state")]
        rows.append(("state", "", version, last_id))
        return self.manifests.write(self.spark.createDataFrame(rows, _MANIFEST).coalesce(1), batch)

    def _at(self, *paths: str) -> tuple:
        ats = [self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
        return (ats[0].getFileSystem(self.spark._jsc.hadoopConfiguration()), *ats)

    def _delete(self, path: str) -> None:
        store, at = self._at(path)
        store.delete(at, True)

    def vacuum(self) -> list[int]:
        """Delete manifests before the last and data versions that it doesn't name."""
        live = {r["version"] for r in self._manifest()}
        self.manifests.vacuum(1)
        store, at = self._at(f"{self.path}/data")
        there = [int(f.getPath().getName()[1:]) for f in store.listStatus(at)] if store.exists(at) else []
        gone = sorted(v for v in there if v not in live and v < max(live, default=0))
        for v in gone:
            self._delete(f"{self.path}/data/v{v}")
        return gone


def initialize(store: RollupStore, rows: DataFrame, now: datetime, lookback: timedelta | None = timedelta(days=2)) -> int:
    """Seed both rollups from the rows since ``now - lookback`` (None: from all), and set the watermark to the greatest id.

    The oldest bucket is rebuilt whole. Late rows of older buckets that came before must have been rolled up before.
    """
    last_id = rows.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).first()[0]
    fresh = {}
    for name, stride in rollup.STRIDES.items():
        some = rows.where(F.col("id") <= last_id)  # what comes in meanwhile is for the next batch
        if lookback is not None:
            some = some.where(F.col("event_time") >= time_bucket(F.lit(now - lookback).cast("timestamp_ntz"), stride))
        fresh[name] = rollup.build(some, stride)
    store.commit(last_id, fresh, lambda current, new: replace_by_key(current, new, rollup.KEYS))
    return last_id


def run_batch(store: RollupStore, rows: DataFrame, size: int = BATCH) -> dict:
    """Merge the next ``size`` rows past the watermark into both rollups; what was processed (n_rows, first_id, last_id)."""
    last_id = store.last_id()
    stats = rollup.batch_stats(rollup.next_batch(rows.select("id"), last_id, size)).first().asDict()
    if stats["n_rows"]:
        # by the ids found, so that the rows are read with a range that reaches the scan, not sorted again
        batch = rows.where(F.col("id").between(stats["first_id"], stats["last_id"]))
        store.commit(stats["last_id"], {n: rollup.build(batch, s) for n, s in rollup.STRIDES.items()}, rollup.merge)
    return stats


def run(store: RollupStore, rows: DataFrame, size: int = BATCH) -> int:
    """Batches until the watermark has reached the last row; how many rows they held."""
    total = 0
    while n := run_batch(store, rows, size)["n_rows"]:
        total += n
    return total
