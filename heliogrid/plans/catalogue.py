"""Named queries over the test tables, each with the SQL that gives the same rows.

``events`` stands in for measurements (a user is a device, an event type a metric), customers, orders and
line items for registries, runs and children. Times are literals, never the clock.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.functions.params import HistoryParams
from heliogrid.functions.rounding import round_exact
from heliogrid.functions.safe import date_at, int_at, int_or_null, number_at, percent
from heliogrid.functions.timebucket import time_bucket, truncate_hour, working_flags
from heliogrid.operators import energy, fleet, history, pv, recent, retention, rollup, rollup_job, runs
from heliogrid.operators.upsert import cascade, last_by_key, merge_registry, replace_by_key
from heliogrid.plans import sql as table_functions
from heliogrid.sources import forecast, landed, message_log, messages
from heliogrid.streaming import ingest, liveness

Query = Callable[[SparkSession, str], DataFrame]
NOW = datetime(2024, 1, 31)
DEVICE = "7"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

UNIT = "case event_type when 'click' then 'C' when 'error' then '%' when 'purchase' then 'ppm' when 'signup' then 'W' end"
MEASURES = f"select event_id as id, cast(user_id as varchar) as device_id, event_type as metric, value, {UNIT} as unit, ts as event_time from events"


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, or in a temporary one where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="heliogrid-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("device_id"), F.col("event_type").alias("metric"), "value", F.expr(UNIT).alias("unit"), F.col("ts").alias("event_time"))


def _bucket(interval: str, column: str = "event_time") -> str:
    return f"time_bucket(interval '{interval}', {column}, timestamp '2001-01-01 00:00:00')"


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _averages(interval: str, where: str) -> str:
    return f"select device_id, metric, unit, {_bucket(interval)} as bucket, round(avg(value), 6) as value from m where {where} group by all"


@query(f"""with m as ({MEASURES}), a as ({_averages("1 minute", f"device_id = '{DEVICE}'")}),
last as (select distinct bucket from a order by bucket desc nulls first limit 30)
select device_id, metric, unit, bucket, value from a where bucket in (select bucket from last)""")
def latest_minute_snapshots(spark, sf_dir):
    return _six(history.latest(measures(spark, sf_dir), DEVICE, limit=30), "value")


@query(f"""with m as ({MEASURES}), a as ({_averages("1 minute", f"device_id = '{DEVICE}'")}),
last as (select distinct bucket from a order by bucket desc nulls first limit 30)
select device_id, bucket, count(distinct metric) as n_metrics, string_agg(metric || '=' || round(value * 1000)::bigint || coalesce(unit, ''), ',' order by metric) as measurements
from a where bucket in (select bucket from last) group by device_id, bucket""")
def snapshot_maps(spark, sf_dir):
    rows = history.snapshots(history.latest(measures(spark, sf_dir), DEVICE, limit=30))
    text = F.transform(F.map_entries("measurements"), lambda e: F.concat(e.key, F.lit("="), F.round(e.value.value * 1000).cast("long").cast("string"), F.coalesce(e.value.unit, F.lit(""))))
    return rows.select("device_id", "bucket", F.size("measurements").cast("long").alias("n_metrics"), F.array_join(text, ",").alias("measurements"))


@query(f"""with m as ({MEASURES}) {_averages("7 minutes", f"device_id = '{DEVICE}' and event_time >= timestamp '2024-01-05' and event_time < timestamp '2024-01-25 23:59:59.999999'")}""")
def history_raw_range_7min(spark, sf_dir):
    p = HistoryParams(start="2024-01-05", end="2024-01-25", aggregate="avg", bucket_unit="minute", bucket_size=7)
    return _six(history.history(measures(spark, sf_dir), {}, None, DEVICE, p, NOW), "value")


@query(f"""with m as ({MEASURES}), a as ({_averages("1 minute", f"device_id = '{DEVICE}' and metric in ('click', 'view') and event_time >= timestamp '2024-01-08 12:00:00' and event_time < timestamp '2024-01-09 12:00:00'")}),
last as (select distinct bucket from a order by bucket desc nulls first limit 5)
select device_id, metric, unit, bucket, value from a where bucket in (select bucket from last)""")
def history_last_n_buckets(spark, sf_dir):
    p = HistoryParams(metrics=["click", "view"], limit=5)
    return _six(history.raw_history(measures(spark, sf_dir), DEVICE, p, datetime(2024, 1, 9, 12)), "value")


@query(f"""with m as ({MEASURES}) select device_id, metric, unit, {_bucket("7 days")} as bucket, round(avg(value), 6) as value from m group by all""")
def bucket_averages_weekly(spark, sf_dir):
    return _six(history.averages(measures(spark, sf_dir), 7 * 86400), "value")


@query(f"""select o_orderkey, {_bucket("7 hours", "o_orderdate")} as bucket_7h, {_bucket("7 days", "o_orderdate")} as bucket_7d from orders""")
def bucket_before_origin(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", time_bucket(F.col("o_orderdate"), 7 * 3600).alias("bucket_7h"), time_bucket(F.col("o_orderdate"), 7 * 86400).alias("bucket_7d"))


def _rollup_sql(interval: str, extra: str = "") -> str:
    return f"""select device_id, metric, max(unit) as unit, {_bucket(interval)} as bucket_start, round(avg(value), 6) as value_avg, min(value) as value_min,
max(value) as value_max, cast(count(*) as integer) as sample_count from m where value is not null and event_time is not null {extra} group by 1, 2, 4"""


@query(f"with m as ({MEASURES}) {_rollup_sql('5 minutes')}")
def rollup_5min(spark, sf_dir):
    return _six(rollup.build(measures(spark, sf_dir), rollup.STRIDES["5min"]), "value_avg")


@query(f"with m as ({MEASURES}) {_rollup_sql('1 hour')}")
def rollup_hourly(spark, sf_dir):
    return _six(rollup.build(measures(spark, sf_dir), rollup.STRIDES["hourly"]), "value_avg")


@query(f"""with m as ({MEASURES}) select device_id, metric, unit, {_bucket("1 day")} as bucket_start, round(avg(value), 6) as value_avg, min(value) as value_min,
max(value) as value_max, cast(count(*) as integer) as sample_count from m group by 1, 2, 3, 4""")
def rollup_daily_by_unit(spark, sf_dir):
    return _six(rollup.build(measures(spark, sf_dir), 86400, by_unit=True, drop_nulls=False), "value_avg")


@query(f"with m as ({MEASURES}) {_rollup_sql('1 hour')}")
def rollup_incremental_merge(spark, sf_dir):
    """Three id batches merged one after the other equal the one-shot rollup."""
    m = measures(spark, sf_dir)
    parts = [m.where("id < 3000"), m.where("id >= 3000 and id < 7000"), m.where("id >= 7000")]
    out = rollup.build(parts[0], 3600)
    for p in parts[1:]:
        out = rollup.merge(out, rollup.build(p, 3600))
    return _six(out.select("device_id", "metric", "unit", "bucket_start", "value_avg", "value_min", "value_max", "sample_count"), "value_avg")


WATERMARK = 6000


def _hybrid(table: str, unit: str, size: int, interval: str, base: str) -> None:
    sql = f"""with m as ({MEASURES}), r as (select device_id, metric, max(unit) as unit, {_bucket(base)} as bucket_start, avg(value) as value_avg, count(*) as sample_count
from m where id <= {WATERMARK} group by 1, 2, 4),
parts as (select device_id, metric, {_bucket(interval)} as bucket, sum(value) as total, count(*) as n, max(unit) as unit from m
where device_id = '{DEVICE}' and id > {WATERMARK} and event_time >= timestamp '2024-01-02' and event_time < timestamp '2024-01-29 23:59:59.999999' group by 1, 2, 3
union all select device_id, metric, {_bucket(interval, "bucket_start")}, value_avg * sample_count, sample_count, unit from r
where device_id = '{DEVICE}' and bucket_start >= timestamp '2024-01-02' and bucket_start < timestamp '2024-01-29 23:59:59.999999')
select device_id, metric, bucket, max(unit) as unit, round(sum(total) / nullif(sum(n), 0), 6) as value from parts group by 1, 2, 3"""

    def run(spark, sf_dir):
        m = measures(spark, sf_dir)
        made = rollup.build(m.where(F.col("id") <= WATERMARK), rollup.STRIDES[table])
        p = HistoryParams(start="2024-01-02", end="2024-01-29", aggregate="avg", bucket_unit=unit, bucket_size=size)
        return _six(history.history(m, {table: made}, WATERMARK, DEVICE, p, NOW), "value")

    run.__name__ = f"history_from_rollup_{interval.replace(' ', '_')}"
    query(sql)(run)


_hybrid("5min", "minute", 15, "15 minutes", "5 minutes")
_hybrid("hourly", "hour", 6, "6 hours", "1 hour")
_hybrid("hourly", "day", 1, "1 day", "1 hour")


@query(f"select cast({WATERMARK} as bigint) as last_measurement_id, coalesce(max(event_id), 0) as max_id, coalesce(max(event_id), 0) - {WATERMARK} as lag from events")
def rollup_state_lag(spark, sf_dir):
    return rollup.state_lag(measures(spark, sf_dir), WATERMARK)


@query(f"select count(*) as n_rows, min(id) as first_id, max(id) as last_id from (select event_id as id from events where event_id > {WATERMARK} order by event_id limit 2500)")
def rollup_batch_stats(spark, sf_dir):
    return rollup.batch_stats(rollup.next_batch(measures(spark, sf_dir), WATERMARK, 2500))


@query(f"""with m as ({MEASURES}), old as ({_rollup_sql('1 hour')}), fresh as ({_rollup_sql('1 hour', "and event_time >= timestamp '2024-01-28 23:40:00'")})
select * from old where (device_id, metric, bucket_start) not in (select (device_id, metric, bucket_start) from fresh) union all select * from fresh""")
def rollup_seed(spark, sf_dir):
    """All rows were rolled up; the look-back from twenty to the hour rebuilds its first bucket from its rest only."""
    m = measures(spark, sf_dir)
    return _six(rollup.seed(rollup.build(m, 3600), m, 3600, NOW - timedelta(minutes=20), aligned=False), "value_avg")


@query(f"with m as ({MEASURES}) {_rollup_sql('1 hour')}")
def rollup_seed_whole(spark, sf_dir):
    """Everything before the last day was rolled up; with the look-back of two days put over it, no row is left out."""
    m = measures(spark, sf_dir)
    old = m.where(F.col("event_time") < F.lit(NOW - timedelta(days=1)).cast("timestamp_ntz"))
    return _six(rollup.seed(rollup.build(old, 3600), m, 3600, NOW), "value_avg")


@query(f"""with m as ({MEASURES}), s as (select max(id) + 1 as last_id from m)
select '5min' as rollup, r.*, s.last_id from ({_rollup_sql('5 minutes')}) r, s union all select 'hourly', r.*, s.last_id from ({_rollup_sql('1 hour')}) r, s""")
def rollup_job_tables(spark, sf_dir):
    """The job in bounded batches from an empty store: both rollups and the watermark of its last commit. Ids start at 1."""
    m = measures(spark, sf_dir).withColumn("id", F.col("id") + 1)
    store = rollup_job.RollupStore(spark, work_folder(spark, "job"))
    rollup_job.initialize(store, m.where("id <= 2000"), NOW, None)
    rollup_job.run(store, m, m.count() // 2 + 1)
    names = ["device_id", "metric", "unit", "bucket_start", "value_avg", "value_min", "value_max", "sample_count"]
    one = lambda n: store.table(n).select(F.lit(n).alias("rollup"), *names, F.lit(store.last_id()).cast("long").alias("last_id"))
    return _six(one("5min").unionByName(one("hourly")), "value_avg")


_DOOMED = f"select event_id as id, ts as event_time from events where ts < timestamp '2024-01-24' and event_id <= {WATERMARK} order by event_id limit 4000"


@query(_DOOMED)
def retention_doomed(spark, sf_dir):
    return rollup.doomed(measures(spark, sf_dir), WATERMARK, NOW, timedelta(days=7), 4000).select("id", "event_time")


@query(f"select event_id as id, ts as event_time from events where event_id not in (select id from ({_DOOMED}))")
def retention_survivors(spark, sf_dir):
    return rollup.survivors(measures(spark, sf_dir), WATERMARK, NOW, timedelta(days=7), 4000).select("id", "event_time")


@query("select event_id as id, ts as event_time from events where ts is null or ts >= timestamp '2024-01-17'")
def retention_unbounded(spark, sf_dir):
    return rollup.expire(measures(spark, sf_dir), NOW, timedelta(days=14)).select("id", "event_time")


def _flags(at: str) -> str:
    local = f"timezone('Europe/Athens', timezone('UTC', {at}))"
    day = f"isodow({local}) <= 5"
    return f"cast({day} as smallint) as is_working_day, cast({day} and hour({local}) >= 8 and hour({local}) < 14 as smallint) as is_working_hour"


def _exact(x: str) -> str:
    """Rounded to 3 digits by the binary value: what a number prints as."""
    return f"printf('%.3f', {x})::double"


def _counter_sql(interval: str) -> str:
    return f"""select device_id, window_start, {_exact('delta')} as energy_wh, window_start + interval '{interval}' as window_end, {_flags("window_start")} from
(select device_id, {_bucket(interval)} as window_start, arg_max(value, (event_time, id)) - arg_min(value, (event_time, id)) as delta from m where value is not null group by 1, 2) where delta >= 0"""


@query(f"with m as ({MEASURES}) {_counter_sql('1 hour')}")
def counter_delta_hourly(spark, sf_dir):
    return energy.counter_delta(measures(spark, sf_dir))


PHASES = {"a": "click", "b": "view", "c": "purchase"}


def _phase_sql(interval: str) -> str:
    wide = ", ".join(f"arg_max(value, id) filter (where metric = '{m}') as {p}" for p, m in PHASES.items())
    parts = ", ".join(f"({p} + lag({p}) over w) / 2 * (date_diff('microsecond', lag(event_time) over w, event_time) / 3.6e9) as {p}_part" for p in PHASES)
    sums = ", ".join(f"coalesce(sum({p}_part), 0) as {p}" for p in PHASES)
    out = ", ".join(f"{_exact(p)} as {p}_energy_wh" for p in PHASES)
    return f"""select device_id, window_start, {out}, {_exact("a + b + c")} as total_energy_wh, window_start + interval '{interval}' as window_end, {_flags("window_start")} from
(select device_id, window_start, count(*) as n, {sums} from (select device_id, window_start, {parts} from
(select device_id, {_bucket(interval)} as window_start, event_time, {wide} from m where metric in ('click', 'view', 'purchase') group by 1, 2, 3)
window w as (partition by device_id, window_start order by event_time)) group by 1, 2) where n >= 2"""


@query(f"with m as ({MEASURES}) {_phase_sql('1 day')}")
def phase_energy_daily(spark, sf_dir):
    return energy.phase_energy(measures(spark, sf_dir), PHASES, 86400)


@query(f"with m as ({MEASURES}) {_phase_sql('1 hour')}")
def phase_energy_hourly(spark, sf_dir):
    return energy.phase_energy(measures(spark, sf_dir), PHASES)


@query(f"select event_id, {_flags('ts')}, date_trunc('hour', ts) as hour_start from events")
def working_flags_events(spark, sf_dir):
    day, hour = working_flags(F.col("ts"))
    return load(spark, sf_dir, "events").select("event_id", day.alias("is_working_day"), hour.alias("is_working_hour"), truncate_hour(F.col("ts")).alias("hour_start"))


def _windows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Devices with even numbers as plugs, odd ones as three-phase meters."""
    m = measures(spark, sf_dir)
    number = F.col("device_id").cast("long") % 2
    plug = energy.counter_delta(m.where(number == 0).withColumn("device_id", F.concat(F.lit(energy.PREFIXES["plug"] + "-"), "device_id")))
    three = energy.phase_energy(m.where(number == 1).withColumn("device_id", F.concat(F.lit(energy.PREFIXES["three_phase"] + "-"), "device_id")), PHASES)
    return plug, three


_START, _END = datetime(2024, 1, 3), datetime(2024, 1, 27, 23, 59, 59, 999999)
_EVEN = f"select id, '{energy.PREFIXES['plug']}-' || device_id as device_id, metric, value, unit, event_time from ({MEASURES}) where cast(device_id as bigint) % 2 = 0"
_ODD = f"select id, '{energy.PREFIXES['three_phase']}-' || device_id as device_id, metric, value, unit, event_time from ({MEASURES}) where cast(device_id as bigint) % 2 = 1"
_INSIDE = "window_start >= timestamp '2024-01-03' and window_end <= timestamp '2024-01-27 23:59:59.999999' and is_working_day = 1 and is_working_hour = 1"
_PLUG = f"(with m as ({_EVEN}) {_counter_sql('1 hour')})"
_THREE = f"(with m as ({_ODD}) {_phase_sql('1 hour')})"


@query(f"""select device_id, 'plug' as device_type, window_start, window_end, energy_wh, null::double as a_energy_wh, null::double as total_energy_wh from {_PLUG} where {_INSIDE}
union all select device_id, 'three_phase', window_start, window_end, null, a_energy_wh, total_energy_wh from {_THREE} where {_INSIDE}""")
def energy_listing(spark, sf_dir):
    out = energy.listing(*_windows(spark, sf_dir), _START, _END, working_only=True)
    return out.select("device_id", "device_type", "window_start", "window_end", "energy_wh", "a_energy_wh", "total_energy_wh")


PHASE_COLUMNS = energy.PHASE_COLUMNS
_PHASE_SUMS = ", ".join(f"round(coalesce(sum({c}), 0), 3) as {c}" for c in PHASE_COLUMNS)


def _three(df: DataFrame) -> DataFrame:
    """Energies to 3 digits."""
    return df.withColumns({c: F.round(c, 3) for c in df.columns if c.endswith("_wh")})


@query(f"""select device_id, round(coalesce(sum(wh), 0), 3) as energy_wh from (select device_id, energy_wh as wh from {_PLUG} where {_INSIDE}
union all select device_id, total_energy_wh from {_THREE} where {_INSIDE}) group by 1""")
def energy_totals_working(spark, sf_dir):
    """One number a device of either kind, in working periods."""
    rows = energy.listing(*_windows(spark, sf_dir), _START, _END, working_only=True)
    return _three(energy.totals(rows.withColumn("energy_wh", F.coalesce("energy_wh", "total_energy_wh")), ["energy_wh"]))


@query(f"""select device_id, 'plug' as device_type, round(coalesce(sum(energy_wh), 0), 3) as energy_wh, {", ".join(f"null::double as {c}" for c in PHASE_COLUMNS)} from {_PLUG} where {_INSIDE} group by 1
union all select device_id, 'three_phase', null, {_PHASE_SUMS} from {_THREE} where {_INSIDE} group by 1""")
def energy_totals_working_both(spark, sf_dir):
    """Sums a device of both meter kinds, each in its own columns."""
    plug, three = (energy.select_windows(x, _START, _END, working_only=True) for x in _windows(spark, sf_dir))
    plug = energy.totals(plug, ["energy_wh"]).withColumn("device_type", F.lit("plug"))
    three = energy.totals(three, PHASE_COLUMNS).withColumn("device_type", F.lit("three_phase"))
    return _three(plug.unionByName(three, allowMissingColumns=True))


_RANGE = "window_start >= timestamp '2024-01-03' and window_end <= timestamp '2024-01-27 23:59:59.999999'"


@query(f"""select * from (select round(coalesce(sum(energy_wh), 0), 3) as energy_wh from {_PLUG} where {_RANGE}), (select {_PHASE_SUMS} from {_THREE} where {_RANGE})""")
def energy_total_both(spark, sf_dir):
    """One row of sums over all windows of all devices in the range."""
    rows = energy.listing(*_windows(spark, sf_dir), _START, _END)
    return _three(energy.totals(rows, ["energy_wh", *PHASE_COLUMNS], per_device=False))


_ONE = f"{energy.PREFIXES['plug']}-2"


@query(f"select round(coalesce(sum(energy_wh), 0), 3) as energy_wh from {_PLUG} where {_RANGE} and device_id = '{_ONE}'")
def energy_total_single(spark, sf_dir):
    """The sum of one device's windows in the range."""
    rows = energy.select_windows(_windows(spark, sf_dir)[0], _START, _END, [_ONE])
    return _three(energy.totals(rows, ["energy_wh"], per_device=False))


_IDS = [f"{energy.PREFIXES[k]}-{n}" for k, n in (("three_phase", 7), ("plug", 2), ("plug", 99_999_998), ("three_phase", 3), ("plug", 14))]
_WANTED = f"(select unnest([{', '.join(repr(i) for i in _IDS)}]) as device_id)"


@query(f"""select device_id, 'plug' as device_type, window_start, energy_wh, null::double as total_energy_wh from {_PLUG} where {_RANGE} and device_id in (select device_id from {_WANTED})
union all select device_id, 'three_phase', window_start, null, total_energy_wh from {_THREE} where {_RANGE} and device_id in (select device_id from {_WANTED})""")
def energy_listing_by_devices(spark, sf_dir):
    """Windows of named devices, each looked up among those of its kind."""
    return energy.listing_of(_IDS, *_windows(spark, sf_dir), _START, _END).select("device_id", "device_type", "window_start", "energy_wh", "total_energy_wh")


@query(f"""select device_id, case when device_id like '{energy.PREFIXES['plug']}%' then 'plug' else 'three_phase' end as device_type,
case when device_type = 'plug' then coalesce(p.energy_wh, 0) end as energy_wh, {", ".join(f"case when device_type = 'three_phase' then coalesce(t.{c}, 0) end as {c}" for c in PHASE_COLUMNS)} from {_WANTED}
left join (select device_id, round(sum(energy_wh), 3) as energy_wh from {_PLUG} where {_RANGE} group by 1) p using (device_id) left join (select device_id, {_PHASE_SUMS} from {_THREE} where {_RANGE} group by 1) t using (device_id)""")
def energy_totals_by_devices(spark, sf_dir):
    """Sums of named devices of both kinds; one without windows has zeros."""
    return energy.totals_of(_IDS, *_windows(spark, sf_dir), _START, _END)


_EARLY = "metric in ('click', 'view', 'error')"


@query(f"""with fresh as (with m as ({MEASURES}) {_counter_sql('1 hour')}), old as (with m as (select * from ({MEASURES}) where {_EARLY}) {_counter_sql('1 hour')})
select * from fresh union all select * from old where (device_id, window_start) not in (select (device_id, window_start) from fresh)""")
def energy_refresh_plug(spark, sf_dir):
    """Windows stored from the metrics that came first; with the late ones all are computed anew from the whole table and replaced."""
    m = measures(spark, sf_dir)
    return energy.refresh(energy.counter_delta(m.where(_EARLY)), m, energy.counter_delta)


@query(f"""with fresh as (with m as ({MEASURES}) {_phase_sql('1 hour')}), old as (with m as (select * from ({MEASURES}) where metric = 'click') {_phase_sql('1 hour')})
select * from fresh union all select * from old where (device_id, window_start) not in (select (device_id, window_start) from fresh)""")
def energy_refresh_phases(spark, sf_dir):
    """The same for three phases, of which one came first."""
    m, compute = measures(spark, sf_dir), lambda rows: energy.phase_energy(rows, PHASES)
    return energy.refresh(compute(m.where("metric = 'click'")), m, compute)


_LATE = "id % 3 = 0 and device_id <> '5'"


def _stored_samples(spark, sf_dir) -> DataFrame:
    """Samples as they are stored by day, the late ones among them."""
    folder = work_folder(spark, "samples")
    retention.store(measures(spark, sf_dir), folder)
    return retention.stored(spark, folder)


@query(f"with m as ({MEASURES}) {_counter_sql('1 hour')}")
def energy_incremental_plug(spark, sf_dir):
    """Windows stored without the late samples, then only those that late samples fall into computed anew: what all samples give at once."""
    m = _stored_samples(spark, sf_dir)
    old = energy.counter_delta(m.where(f"not ({_LATE})"))
    dropped = energy.recompute(m, m.where(_LATE), energy.counter_delta, day="day").select(*energy.WINDOW)
    # a window that late samples show to be a reset goes, which `refresh_touched` would keep
    touched = energy.touched(m.where(_LATE)).select("device_id", "window_start").join(dropped, ["device_id", "window_start"], "left_anti")
    return energy.refresh_touched(old, m, m.where(_LATE), energy.counter_delta, day="day").join(touched, ["device_id", "window_start"], "left_anti")


@query(f"with m as ({MEASURES}) {_phase_sql('1 hour')}")
def energy_incremental_phases(spark, sf_dir):
    """The same for three phases, whose windows only ever gain times."""
    m, compute = _stored_samples(spark, sf_dir), lambda rows: energy.phase_energy(rows, PHASES)
    return energy.refresh_touched(compute(m.where(f"not ({_LATE})")), m, m.where(_LATE), compute, day="day")


@query("""select event_id, printf('%.3f', value)::double as three, printf('%.1f', value * 8)::double as one, printf('%.3f', (event_id * 2 + 1) / 16)::double as ties, printf('%.0f', (event_id + 0.5)::double)::double as whole from events""")
def exact_rounding(spark, sf_dir):
    """Doubles rounded by their binary value, ties to even: as they print."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", round_exact(F.col("value")).alias("three"), round_exact(F.col("value") * 8, 1).alias("one"), round_exact((F.col("event_id") * 2 + 1) / F.lit(16.0)).alias("ties"), round_exact(F.col("event_id") + 0.5, 0).alias("whole"))


@query(f"select event_id as id, ts as event_time from events where event_id not in (select id from ({_DOOMED})) and ts is not null")
def retention_stored(spark, sf_dir):
    """The bounded delete on a table stored by day, whose untouched days stay as they are."""
    folder = work_folder(spark, "retention")
    retention.store(measures(spark, sf_dir).where("event_time is not null"), folder)
    retention.purge(spark, folder, NOW, timedelta(days=7), WATERMARK, 4000)
    return retention.stored(spark, folder).select("id", "event_time")


def _as_messages(spark, sf_dir, topic: str, payload) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.expr(topic).alias("topic"), F.to_json(payload).alias("payload"), F.timestamp_add("HOUR", F.lit(1), F.col("ts").cast("timestamp_ntz")).alias("ingestion_time"))


def _meter_source(spark, sf_dir) -> DataFrame:
    """Events as status messages: counters with a minute, or phases with text in one of them; some on other topics."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    third, fifth = F.col("event_id") % 3 == 0, F.col("event_id") % 5 == 0
    counter = F.when(~third, F.struct(F.when(fifth, F.lit(1.5)).otherwise(F.col("event_id").cast("double")).alias("total"), seconds.alias("minute_ts")))
    payload = F.struct(F.when(~third, F.col("value")).alias("apower"), counter.alias("aenergy"), F.when(third, F.col("value")).alias("total_act_power"), F.when(third, F.lit("7.5")).alias("a_act_power"), F.when(third, F.lit(True)).alias("b_act_power"))
    return _as_messages(spark, sf_dir, "user_id || case when event_id % 7 = 0 then '/online' else '/status/x:0' end", payload)


_METER_SQL = """with e as (select *, date_trunc('second', ts) as sent from events where event_id % 7 <> 0)
select user_id::varchar as device_id, 'apower' as metric, value, 'W' as unit, sent as event_time from e where event_id % 3 <> 0 and value is not null
union all select user_id::varchar, 'aenergy_total', case when event_id % 5 = 0 then 1.5 else event_id end::double, 'Wh', sent from e where event_id % 3 <> 0
union all select user_id::varchar, 'total_act_power', value, 'W', ts + interval 1 hour from e where event_id % 3 = 0 and value is not null"""


@query(_METER_SQL)
def meter_messages_parsed(spark, sf_dir):
    return messages.meter_measurements(messages.meter_messages(_meter_source(spark, sf_dir)))


def _uplinks(spark, sf_dir, keep: list[str] | None = None) -> DataFrame:
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    ids = F.struct(F.when(F.col("event_id") % 11 > 0, F.col("user_id").cast("string")).otherwise("").alias("device_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("dev_eui"))
    environmental = F.struct(F.col("value").alias("temperature"), F.col("event_id").cast("string").alias("relative_humidity"))
    decoded = F.struct(environmental.alias("environmental"), F.struct((F.col("event_id") % 2 == 0).alias("co2")).alias("co2"), F.struct(F.lit("high").alias("voc")).alias("voc_index"))
    payload = F.struct(ids.alias("end_device_ids"), at.alias("received_at"), F.struct(decoded.alias("decoded_payload")).alias("uplink_message"))
    return messages.environmental_messages(_as_messages(spark, sf_dir, "'up'", payload), keep)


@query("""with e as (select * from events where event_id % 11 > 0)
select user_id::varchar as device_id, 'temperature' as metric, value, 'C' as unit, ts as event_time from e where value is not null
union all select user_id::varchar, 'relative_humidity', event_id::double, '%', ts from e""")
def uplink_messages_parsed(spark, sf_dir):
    """Numbers and texts that read as numbers; flags and other texts don't count, nor do messages without a device."""
    return messages.environmental_measurements(_uplinks(spark, sf_dir))


@query("""select 'ttn' as source, user_id::varchar as device_id, arg_max(struct_pack(v := case when event_id % 2 = 0 then event_type end), (ts, event_id)).v as dev_eui, user_id::varchar as name from events where event_id % 11 > 0 group by user_id""")
def uplink_registry(spark, sf_dir):
    """Devices by source and id, named by their id, with what their last message says."""
    known = spark.createDataFrame([], ingest.REGISTRY)
    rows = ingest.registry_rows(_uplinks(spark, sf_dir, ["event_id"]).withColumnsRenamed({"event_id": "id"}).withColumn("name", F.col("device_id")))
    return merge_registry(known, rows, ingest.REGISTRY_KEYS, ["dev_eui"], ["name"], ["at", "id"]).select("source", "device_id", "dev_eui", "name")


def _registry(spark, sf_dir) -> DataFrame:
    """What events say of devices of both kinds; meters have no dev_eui, and a third of the messages no name."""
    meter = F.col("event_id") % 5 == 0
    return load(spark, sf_dir, "events").select(
        F.when(meter, messages.METERS).otherwise(messages.UPLINK).alias("source"), F.col("user_id").cast("string").alias("device_id"), F.when(~meter & (F.col("event_id") % 2 == 0), F.col("event_type")).alias("dev_eui"),
        F.when(F.col("event_id") % 3 > 0, F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))).alias("name"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("at"), F.col("event_id").alias("id"),
    )


@query("""with r as (select case when event_id % 5 = 0 then 'shelly' else 'ttn' end as source, user_id::varchar as device_id, case when event_id % 5 <> 0 and event_id % 2 = 0 then event_type end as dev_eui,
case when event_id % 3 > 0 then event_type || '-' || user_id end as name, (date_trunc('day', ts), event_id) as seq from events)
select source, device_id, arg_max(struct_pack(v := dev_eui), seq).v as dev_eui, arg_max(name, seq) filter (where name is not null) as name from r group by 1, 2""")
def registry_after_two_batches(spark, sf_dir):
    """Two batches, of which the second is the older one, over the registry of the first: the order of the messages counts, not that of the batches."""
    rows = _registry(spark, sf_dir)
    first = merge_registry(spark.createDataFrame([], ingest.REGISTRY), rows.where("id % 4 > 1 or id > 6000"), ingest.REGISTRY_KEYS, ["dev_eui"], ["name"], ["at", "id"])
    return merge_registry(first, rows.where("id % 4 <= 1 and id <= 6000"), ingest.REGISTRY_KEYS, ["dev_eui"], ["name"], ["at", "id"]).select("source", "device_id", "dev_eui", "name")


def _ingested(spark, sf_dir) -> str:
    """Folder of the table that two runs of the ingest stream leave, the second from the checkpoint of the first."""
    folder = work_folder(spark, "ingest")
    rows = _meter_source(spark, sf_dir)
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        message_log.append(rows.where(part).drop("event_id"), f"{folder}/log")
        ingest.ingest(message_log.stream(spark, f"{folder}/log", taskBytes="200000"), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/table"


@query(_METER_SQL)
def message_log_ingest(spark, sf_dir):
    """Status messages through the replayable log and the ingest stream, with a restart between two halves."""
    return ingest.measurements(spark, _ingested(spark, sf_dir)).drop("id")


@query("""select 'shelly' as source, user_id::varchar as device_id, null::varchar as dev_eui, user_id::varchar as name from events where event_id % 7 <> 0 group by 2""")
def message_log_registry(spark, sf_dir):
    """The registry of the same table."""
    return ingest.registry(spark, _ingested(spark, sf_dir)).select("source", "device_id", "dev_eui", "name")


@query("""select o_orderkey, trunc(o_totalprice)::bigint as number, case when o_totalprice = trunc(o_totalprice) then null end::bigint as fraction_text, o_orderkey::bigint as whole_text, 1::bigint as flag,
o_orderdate::date::varchar as day, null::varchar as day_and_time, o_orderdate::date::varchar as compact_day from orders""")
def loose_values(spark, sf_dir):
    """Numbers are cut, text has to be whole, flags count as 1; a date is a date alone."""
    o = load(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    body = F.struct(F.col("o_totalprice").alias("number"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")).alias("fraction_text"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("whole_text"), F.lit(True).alias("flag"), day.alias("day"), F.concat(day, F.lit("T05")).alias("day_and_time"), F.date_format("o_orderdate", "yyyyMMdd").alias("compact_day"))
    v = F.parse_json(F.to_json(body))
    return o.select("o_orderkey", *[int_at(v, f"$.{c}").alias(c) for c in ("number", "fraction_text", "whole_text", "flag")], *[date_at(v, f"$.{c}").cast("string").alias(c) for c in ("day", "day_and_time", "compact_day")])


@query(f"""with m as (select distinct c_custkey::varchar as device_id, 'environmental' as kind from customer union all select distinct 's' || s_suppkey, 'meter' from supplier),
seen as (select user_id::varchar as device_id, max(ts) as last_reading_at from events group by 1 union all select 's' || user_id, max(ts) from events group by 1),
f as (select m.device_id, kind, last_reading_at from m left join seen on m.device_id = seen.device_id)
select count(*) as total, count(*) filter (where last_reading_at >= timestamp '2024-01-30 23:45:00') as live,
count(*) filter (where last_reading_at < timestamp '2024-01-30 23:45:00' and last_reading_at >= timestamp '2024-01-30 00:00:00') as stale,
count(*) filter (where last_reading_at is null or last_reading_at < timestamp '2024-01-30 00:00:00') as offline,
count(*) filter (where kind = 'environmental') as environmental, count(*) filter (where kind = 'meter') as meter, max(last_reading_at) as latest_reading_at,
round(greatest(0, least(100, live * 100.0::double / total)), 1) as availability from f""")
def fleet_status(spark, sf_dir):
    e = measures(spark, sf_dir)
    env = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("device_id"))
    met = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("device_id"))
    other = e.withColumn("device_id", F.concat(F.lit("s"), "device_id"))
    return fleet.status([fleet.last_seen(env, e, "environmental"), fleet.last_seen(met, other, "meter")], NOW)


@query("""with b as (select user_id as device_id, case when event_id % 3 = 0 then event_type end as dev_eui, case when event_id % 2 = 0 then event_type end as name, event_id as seq from events)
select device_id, arg_max(struct_pack(v := dev_eui), seq).v as dev_eui, arg_max(name, seq) filter (where name is not null) as name from b group by 1""")
def device_registry_merge(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("device_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("dev_eui"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("name"), F.col("event_id").alias("at"))
    old, new = rows.where("at < 4000"), rows.where("at >= 4000")
    first = merge_registry(spark.createDataFrame([], "device_id long, dev_eui string, name string, at long, name_at long"), old, ["device_id"], ["dev_eui"], ["name"], ["at"])
    return merge_registry(first, new, ["device_id"], ["dev_eui"], ["name"], ["at"]).select("device_id", "dev_eui", "name")


@query("""with o as (select o_orderkey as k, o_totalprice as v from orders), n as (select l_orderkey as k, round(sum(l_extendedprice), 2) as v from lineitem where l_linenumber = 1 and l_returnflag = 'R' group by 1)
select k, v from o where k not in (select k from n) union all select k, v from n""")
def replace_rows_by_key(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    n = load(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return replace_by_key(o, n, ["k"])


@query("select event_id, cast(json_extract(props, '$.k') as double) as k from events")
def json_metric_extract(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", number_at(F.try_parse_json("props"), "$.k").alias("k"))


@query("""select l_orderkey, l_linenumber, 'l_quantity' as metric, l_quantity as value from lineitem union all select l_orderkey, l_linenumber, 'l_discount', l_discount from lineitem
union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem""")
def measurements_unpivot(spark, sf_dir):
    return messages.unpivot(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("""select vec_id, label, cast(generate_subscripts(embedding, 1) - 1 as integer) as position, round(unnest(embedding)::double, 6) as v from embeddings""")
def array_rows_explode(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    out = forecast.array_rows(e, {"embedding": F.col("embedding")})
    return out.select("vec_id", "label", "position", F.round(F.col("embedding").cast("double"), 6).alias("v"))


@query("""with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders where o_orderstatus = 'F')
select o_custkey, o_orderkey, o_orderdate, l_linenumber, l_quantity from r left join lineitem on l_orderkey = o_orderkey where n = 1""")
def latest_parent_with_children(spark, sf_dir):
    last = runs.latest_per_group(load(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    out = runs.with_children(last, load(spark, sf_dir, "lineitem"), "l_orderkey", "o_orderkey")
    return out.select("o_custkey", "o_orderkey", "o_orderdate", "l_linenumber", "l_quantity")


@query("""select o_orderkey, o_orderdate from orders where o_orderstatus = 'F' order by o_orderdate desc nulls first, o_orderkey desc limit 1""")
def latest_successful_run(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderstatus") == "F").alias("success"))
    return runs.latest_successful(o).select(F.col("id").alias("o_orderkey"), F.col("started_at").alias("o_orderdate"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def pending_targets(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("success"))
    return runs.pending(load(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"])


@query("select event_id, ts from events where ts between timestamp '2024-01-09 06:00:00' and timestamp '2024-01-15 23:59:59.999999'")
def forecast_range(spark, sf_dir):
    return forecast.in_range(load(spark, sf_dir, "events").select("event_id", "ts"), datetime(2024, 1, 9, 6), datetime(2024, 1, 15, 23, 59, 59, 999999), "ts")


@query("select event_id, ts from events where ts >= timestamp '2024-01-12 15:00:00' order by ts limit 1")
def nearest_future(spark, sf_dir):
    return forecast.nearest_future(load(spark, sf_dir, "events").select("event_id", "ts"), datetime(2024, 1, 12, 15, 20), "ts")


_PV = "select event_id, ts as forecast_timestamp, value as ghi from events"


@query(f"""select event_id, round(sin(2 * pi() * hour(forecast_timestamp) / 24), 6) as hour_sin, round(cos(2 * pi() * hour(forecast_timestamp) / 24), 6) as hour_cos, case when hour(forecast_timestamp) = 0 then 0.0::double else 1.5::double end as lag_1h,
round(case when ghi < 20 then 0.0::double else greatest(0.01 * ghi + 0.5 * cos(2 * pi() * hour(forecast_timestamp) / 24) - 0.2 * case when hour(forecast_timestamp) = 0 then 0 else 1.5 end, 0) end, 6) as predicted_power_kw from ({_PV})""")
def pv_features_mask(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", F.col("ts").alias("forecast_timestamp"), F.col("value").alias("ghi"))
    rows = pv.score(pv.features(rows, 1.5), ["ghi", "hour_cos", "lag_1h"], lambda x: 0.01 * x["ghi"] + 0.5 * x["hour_cos"] - 0.2 * x["lag_1h"])
    return _six(pv.clip_and_mask(rows, "raw_kw", "ghi"), "hour_sin", "hour_cos", "predicted_power_kw").select("event_id", "hour_sin", "hour_cos", "lag_1h", "predicted_power_kw")


@query(f"""with p as (select ghi, 0.01 * ghi - 0.1 as raw_kw from ({_PV}))
select round(sum(case when ghi < 20 then 0 else greatest(raw_kw, 0) end), 4) as daily_energy_kwh, round(min(raw_kw), 6) as raw_min, round(max(raw_kw), 6) as raw_max, round(avg(raw_kw), 6) as raw_mean, bool_and(raw_kw <= 0) as none_positive from p""")
def pv_diagnostics(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("value").alias("ghi"), (F.lit(0.01) * F.col("value") - 0.1).alias("raw_kw"))
    out = pv.diagnostics(pv.clip_and_mask(rows, "raw_kw", "ghi"), "raw_kw")
    return _six(out, "raw_min", "raw_max", "raw_mean").withColumn("daily_energy_kwh", F.round("daily_energy_kwh", 4))


@query("select event_id, ts from events where ts::date = (select d from (select distinct ts::date as d from events) order by d limit 1 offset 1)")
def second_date_slice(spark, sf_dir):
    return pv.second_date(load(spark, sf_dir, "events").select("event_id", "ts"), "ts")


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def dimension_listing(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name").orderBy("n_name")


@query(f"with m as ({MEASURES}) {_rollup_sql('1 hour')}")
def stream_rollup(spark, sf_dir):
    """The rollup of a stream of event files, merged micro-batch by micro-batch."""
    folder = work_folder(spark, "stream")
    load(spark, sf_dir, "events").repartition(3, "event_id").write.parquet(f"{folder}/in")
    schema = load(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("device_id"), F.col("event_type").alias("metric"), "value", F.expr(UNIT).alias("unit"), F.col("ts").alias("event_time"))
    ingest.rollup_stream(stream, f"{folder}/out", f"{folder}/checkpoint", 3600).awaitTermination()
    return _six(ingest.rolled(spark, f"{folder}/out"), "value_avg")


_GAPS = """with e as (select user_id::varchar as device_id, ts as t, lead(ts) over (partition by user_id order by ts) as next, lag(ts) over (partition by user_id order by ts) as prev from events where user_id is not null and ts is not null),
c as (select max(t) as now from e), s(status, wait) as (values ('stale', interval 15 minute), ('offline', interval 24 hour))"""


@query(f"""{_GAPS} select device_id, status, t + wait as "at", t as last_reading_at from e, s, c where t + wait < coalesce(next, now)
union all select device_id, 'live', t, t from e where prev is null or prev + interval 15 minute < t""")
def liveness_changes(spark, sf_dir):
    """Every change of every device in a stream of its readings that comes in three batches; timers give the changes after its last one."""
    out = spark.read.schema(liveness.CHANGES).parquet(f"{_live(spark, sf_dir)}/out")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "last_reading_at")})


@query(f"""{_GAPS}, l as (select device_id, max(t) as t from e group by 1)
select device_id, case when t + interval 24 hour < now then 'offline' when t + interval 15 minute < now then 'stale' else 'live' end as status, t as last_reading_at from l, c""")
def liveness_now(spark, sf_dir):
    """The status of every device when the stream's clock has come to the last reading of all."""
    return liveness.held(spark, f"{_live(spark, sf_dir)}/checkpoint")


def _live(spark, sf_dir) -> str:
    """Folder of the stream's changes and its checkpoint."""
    folder = work_folder(spark, "liveness")
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("device_id"), F.col("ts").cast("timestamp_ntz").alias("event_time"))
    for k, (a, b) in enumerate((("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01"))):
        e.where(f"event_time >= timestamp_ntz'{a} 00:00:00' and event_time < timestamp_ntz'{b} 00:00:00'").write.parquet(f"{folder}/in/part={k}")
        stream = spark.readStream.schema(e.schema).parquet(f"{folder}/in/*")
        liveness.follow(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return folder


@query("select 'environmental' as source, c_custkey, c_name from customer union all select 'meter', s_suppkey, s_name from supplier")
def device_listing(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.lit("environmental").alias("source"), "c_custkey", "c_name")
    s = load(spark, sf_dir, "supplier").select(F.lit("meter").alias("source"), F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return c.unionByName(s).orderBy("source", "c_custkey")


@query("""select source, forecast_timestamp, value, fetched from (select *, row_number() over (partition by source, forecast_timestamp order by fetched desc) as n
from (select event_type as source, date_trunc('hour', ts) as forecast_timestamp, value, event_id as fetched from events)) where n = 1""")
def weather_upsert(spark, sf_dir):
    """Two fetches in a row: of equal (source, hour) the later one stays."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("source"), truncate_hour(F.col("ts")).alias("forecast_timestamp"), "value", F.col("event_id").alias("fetched"))
    keys = ["source", "forecast_timestamp"]
    old, new = (last_by_key(x, keys, ["fetched"]) for x in (e.where("fetched < 5000"), e.where("fetched >= 5000")))
    return replace_by_key(old, new, keys)


@query(f"""with e as (select user_id, date_trunc('hour', ts) as hour, event_id, value from events where user_id is not null and ts is not null and value is not null),
f as (select *, event_id % 2 as turn from e), l as (select user_id, hour, turn, arg_max(value, event_id) as value from f group by all),
w as (select *, row_number() over (partition by user_id, hour order by turn desc) as n, min(turn) over (partition by user_id, hour) as born from l)
select 'open-meteo' as source, (38 + user_id / 10000.0)::decimal(9,6)::double as latitude, 21.7::double as longitude, 'Europe/Athens' as timezone, hour as forecast_timestamp, hour::date::varchar as forecast_date, hour(hour)::integer as forecast_hour,
round(value, 2) as temperature_2m_c, trunc(value)::integer as weather_code, timestamp '2024-02-01' + turn * interval 1 day as fetched_at, timestamp '2024-02-01' + born * interval 1 day as created_at from w where n = 1""")
def weather_payload_upsert(spark, sf_dir):
    """Landed answers of two fetches for many places, keyed by what was asked for: rows of the later fetch stay, and remember when they were first stored."""
    folder, t = work_folder(spark, "weather"), F.col("t")
    e = load(spark, sf_dir, "events").where("user_id is not null and ts is not null and value is not null").withColumn("fetch", F.col("event_id") % 2)
    hourly = e.groupBy("fetch", "user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.max_by("value", "event_id").alias("value"))
    per = hourly.groupBy("fetch", "user_id").agg(F.sort_array(F.collect_list(F.struct("hour", "value"))).alias("t"))
    values = F.struct(F.transform(t, lambda x: F.date_format(x.hour, "yyyy-MM-dd'T'HH:mm")).alias("time"), *[F.transform(t, lambda x: x.value if v == "weather_code" else F.round(x.value, 2)).alias(v) for v in forecast.WEATHER])
    answer = F.to_json(F.struct(F.lit(38.25).alias("latitude"), F.lit(21.75).alias("longitude"), F.lit("GMT").alias("timezone"), values.alias("hourly")))
    per.select("fetch", "user_id", answer.alias("value")).write.partitionBy("fetch").json(f"{folder}/landed")
    out = None
    for fetch, fetched in ((0, datetime(2024, 2, 1)), (1, datetime(2024, 2, 2))):
        request = landed.weather_request(0.0, 21.7, "Europe/Athens", fetched.date())
        held = spark.read.schema("user_id long, value string").json(f"{folder}/landed/fetch={fetch}")
        answers = held.select("user_id", F.from_json("value", forecast.schema(list(forecast.WEATHER))).alias("a")).select("user_id", "a.*")
        rows = forecast.weather_rows(answers, request, fetched)
        rows = rows.withColumn("latitude", (38 + F.col("user_id") / F.lit(10000.0)).cast("decimal(9,6)")).drop("user_id")  # a request a place, of which all are read at once here
        out = rows if out is None else forecast.upsert_weather(out, rows)
    out = out.withColumns({c: F.col(c).cast("double") for c in ("latitude", "longitude", "temperature_2m_c")} | {"forecast_date": F.col("forecast_date").cast("string")})
    return out.select("source", "latitude", "longitude", "timezone", "forecast_timestamp", "forecast_date", "forecast_hour", "temperature_2m_c", "weather_code", "fetched_at", "created_at")


@query("""with n as (select o_orderkey, count(*) as lines from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'A' group by 1)
select o.o_orderkey, case when n.lines is not null then 'done' else o_orderstatus end as status from orders o left join n using (o_orderkey)""")
def run_finish(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    done = load(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return runs.finish(o, done.withColumn("status", F.lit("done")), "o_orderkey")


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as whole, date_diff('microsecond', timestamp '2024-01-01', ts) / 3.6e9 as hours, ts::date::varchar as day, hour(ts)::integer as hour_of_day,
case when value > 0 then round(greatest(0, least(100, value * 100.0::double / 500)), 1) end as share from events""")
def safe_values(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    text = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    hours = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / F.lit(3.6e9)
    share = F.when(F.col("value") > 0, percent(F.col("value"), F.lit(500)))
    return e.select("event_id", int_or_null(text).alias("whole"), hours.alias("hours"), F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour_of_day"), share.alias("share"))


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O')")
def cascade_delete(spark, sf_dir):
    gone = load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    return cascade(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


def _answers(spark, sf_dir) -> DataFrame:
    """Orders as answers of runs: totals as numbers and as text, counts of three kinds, every fifth without a summary object."""
    o = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    summary = F.when(key % 5 > 0, F.struct((key % 7).alias("requested_rooms"), (key % 4).cast("string").alias("successful_rooms"), (key % 3 + 0.5).alias("failed_rooms")))
    totals = F.struct(F.col("o_totalprice").alias("facility_kwh"), F.col("o_totalprice").cast("string").alias("equipment_kwh"), F.lit("much").alias("lighting_kwh"))
    day = F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    body = F.struct(F.col("o_orderstatus").alias("status"), F.lit("engine").alias("simulation_engine"), F.concat(F.lit("x"), key.cast("string")).alias("run_id"), day.alias("day_ahead_date"), summary.alias("summary"), totals.alias("school_totals"), F.struct(key.alias("h0"), (key + 1).alias("h1")).alias("hourly_load"))
    return o.select(key.alias("run_id"), F.to_json(body).alias("response_json"))


@query("""select o_orderkey as run_id, o_orderstatus as status, 'engine' as simulation_engine, 'x' || o_orderkey as external_run_id, o_orderdate::date::varchar as day_ahead_date, case when o_orderkey % 5 > 0 then o_orderkey % 7 end::bigint as requested_rooms,
case when o_orderkey % 5 > 0 then o_orderkey % 4 end::bigint as successful_rooms, case when o_orderkey % 5 > 0 then o_orderkey % 3 end::bigint as failed_rooms, round(o_totalprice, 2) as facility_kwh, round(o_totalprice, 2) as equipment_kwh, null::double as lighting_kwh,
'{"h0":' || o_orderkey || ',"h1":' || (o_orderkey + 1) || '}' as hourly_load from orders""")
def run_answers(spark, sf_dir):
    """Columns of runs out of their answers: whole numbers cut, text that reads as one, sections that aren't objects empty."""
    names = ["facility_kwh", "equipment_kwh", "lighting_kwh"]
    out = runs.run_columns(_answers(spark, sf_dir)).withColumns({n: F.round(F.col(n).cast("double"), 2) for n in names} | {"day_ahead_date": F.col("day_ahead_date").cast("string")})
    return out.select("run_id", "status", "simulation_engine", "external_run_id", "day_ahead_date", *runs.ROOMS, *names, "hourly_load")


def _room_answers(lines: DataFrame, status: str) -> DataFrame:
    """Line items as rooms of their order's answer, in order of their numbers; several lines can name one room."""
    metrics = F.struct(F.col("l_extendedprice").alias("facility_kwh"), F.col("l_quantity").cast("string").alias("thermal_discomfort_hours"))
    room = F.struct(F.concat(F.lit("r"), F.col("l_partkey") % 3).alias("room_id"), F.concat(F.lit(status), F.col("l_returnflag")).alias("status"), metrics.alias("metrics"))
    rooms = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", room.alias("room")))), lambda x: x.room)
    return lines.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.to_json(F.struct(rooms.alias("room_results"))).alias("response_json"))


_ROOMS = "select l_orderkey as run_id, 'r' || l_partkey % 3 as room_id, '{0}' || l_returnflag as status, round(l_extendedprice, 2) as facility_kwh, round(l_quantity, 2) as thermal_discomfort_hours from lineitem where {1} qualify row_number() over (partition by l_orderkey, l_partkey % 3 order by l_linenumber desc, l_returnflag desc, l_extendedprice desc, l_quantity::varchar desc) = 1"


@query(f"""with a as ({_ROOMS.format("", "true")}), b as ({_ROOMS.format("again ", "l_orderkey % 3 = 0 and l_linenumber <= 2")})
select * from a where run_id not in (select run_id from b) union all select * from b""")
def rooms_recorded(spark, sf_dir):
    """Rooms of all answers; a third of the runs are answered again, and only what the later answer names stays of them."""
    lines = load(spark, sf_dir, "lineitem")
    again = _room_answers(lines.where("l_orderkey % 3 = 0 and l_linenumber <= 2"), "again ")
    out = runs.record_rooms(runs.room_results(_room_answers(lines, "")), again)
    return out.select("run_id", "room_id", "status", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("facility_kwh", "thermal_discomfort_hours")])


@query("""with l as (select l_orderkey, string_agg(l_linenumber || ':' || case when l_returnflag = 'A' then 'success:' || (round(l_extendedprice * 100)::bigint) else 'failed:-' end, ',' order by l_linenumber, l_returnflag = 'A', l_extendedprice) as rooms, count(*) as n from lineitem group by 1)
select o_orderkey as id, o_orderstatus as status, o_custkey as requested_rooms, round(o_totalprice, 2) as facility_kwh, coalesce(n, 0) as n_rooms, coalesce(rooms, '') as rooms from orders left join l on l_orderkey = o_orderkey""")
def day_ahead_responses(spark, sf_dir):
    """A response struct for every run, with its rooms in order and metrics where they succeeded."""
    null = lambda t: F.lit(None).cast(t)
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("s").alias("school_id"), F.to_date("o_orderdate").alias("day_ahead_date"), F.col("o_orderstatus").alias("status"), F.lit("e").alias("simulation_engine"), F.lit("x").alias("external_run_id"), F.col("o_custkey").alias("requested_rooms"), null("long").alias("successful_rooms"), null("long").alias("failed_rooms"), *[(F.col("o_totalprice") if n == "facility_kwh" else null("double")).alias(n) for n in runs.TOTALS], null("string").alias("hourly_load"))
    rooms = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("string").alias("room_id"), F.lit("R").alias("room_label"), F.when(F.col("l_returnflag") == "A", "success").otherwise("failed").alias("status"), null("string").alias("error_text"), *[(F.col("l_extendedprice") if n == "facility_kwh" else null("double")).alias(n) for n in runs.ROOM])
    text = F.transform("response.room_results", lambda r: F.concat_ws(":", r.room_id, r.status, F.coalesce(F.round(r.metrics.facility_kwh * 100).cast("long").cast("string"), F.lit("-"))))
    out = runs.day_ahead_response(o, rooms)
    return out.select("response.id", "response.status", "response.summary.requested_rooms", F.round("response.school_totals.facility_kwh", 2).alias("facility_kwh"), F.size("response.room_results").cast("long").alias("n_rooms"), F.array_join(text, ",").alias("rooms"))


@query("""select p_partkey as id, p_name as label, p_size > 25 as cooling_setpoint, p_type as occupancy, round(p_retailprice, 2) as heating_setpoint, '{"k":' || p_partkey || '}' as raw_item from part""")
def recording_responses(spark, sf_dir):
    """Recorded rooms as structs, with what they support and their defaults as numbers."""
    null = lambda t: F.lit(None).cast(t)
    given = {"id": F.col("p_partkey"), "label": F.col("p_name"), "supports_cooling_setpoint": F.col("p_size") > 25, "default_occupancy": F.col("p_type"), "default_heating_setpoint": F.col("p_retailprice").cast("decimal(18,2)"), "raw_item": F.to_json(F.struct(F.col("p_partkey").alias("k")))}
    names = [*runs.RECORDING, "supports_cooling_setpoint", *[f"default_{d}" for d in runs.DEFAULTS], "raw_item", "created_at", "updated_at"]
    r = runs.recording_response(load(spark, sf_dir, "part").select(*[given.get(n, null("string")).alias(n) for n in names]))
    return r.select("response.id", "response.label", "response.supports.cooling_setpoint", "response.defaults.occupancy", F.round("response.defaults.heating_setpoint", 2).alias("heating_setpoint"), "response.raw_item")


_RECORDS = """select event_id % 40 as run_id, ts as forecast_timestamp, ts::date::varchar as forecast_date, hour(ts)::smallint as forecast_hour, round(case when value < 20 then 0 else value / 10 end, 6) as predicted_power_kw,
'{"event_id":' || event_id || ',"user_id":' || coalesce(user_id::varchar, 'null') || '}' as raw_features from events"""


def _pv_rows(spark, sf_dir) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("forecast_timestamp"), (F.col("value") / 10).alias("raw_kw"), F.col("value").alias("ghi"))
    return pv.clip_and_mask(rows, "raw_kw", "ghi")


@query(_RECORDS)
def pv_hourly_records(spark, sf_dir):
    """Rows to append for runs, with the model's inputs as JSON."""
    out = None
    rows = _pv_rows(spark, sf_dir)
    for k in range(40):
        some = pv.hourly_records(rows.where(F.col("event_id") % 40 == k), k, ["event_id", "user_id"])
        out = some if out is None else out.unionByName(some)
    return _six(out.withColumns({"run_id": F.col("run_id").cast("long"), "forecast_date": F.col("forecast_date").cast("string")}), "predicted_power_kw")


@query(f"""with r as ({_RECORDS}) select user_id as run_id, count(*) as n, string_agg(forecast_hour || '=' || round(predicted_power_kw * 1000)::bigint, ',' order by forecast_timestamp, forecast_hour, predicted_power_kw) as hours
from (select r.*, e.user_id from r join events e on r.raw_features like '{{"event_id":' || e.event_id || ',%' and e.ts = r.forecast_timestamp) where user_id is not null group by 1""")
def pv_responses(spark, sf_dir):
    """Hours of every run in order of time."""
    rows = _pv_rows(spark, sf_dir).where("user_id is not null").select(F.col("user_id").alias("run_id"), "forecast_timestamp", F.hour("forecast_timestamp").alias("forecast_hour"), "predicted_power_kw")
    text = F.transform("hours", lambda h: F.concat(h.hour.cast("string"), F.lit("="), F.round(F.round(h.predicted_power_kw, 6) * 1000).cast("long").cast("string")))
    return pv.pv_response(rows).select("run_id", F.size("hours").cast("long").alias("n"), F.array_join(text, ",").alias("hours"))


@query("""select c_custkey, c_nationkey, (select max(o_orderkey) from orders) + row_number() over (order by c_custkey, c_nationkey) as id from customer""")
def run_create(spark, sf_dir):
    """New runs take the ids after the greatest there is, in order of what they ask for."""
    have = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return runs.create(have, load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))


@query(SQL["latest_minute_snapshots"])
def latest_from_kept_minutes(spark, sf_dir):
    """The last minutes from entries merged of two batches by id, and the raw rows past the watermark."""
    m = measures(spark, sf_dir)
    entries = recent.merge(recent.build(m.where("id <= 3000")), recent.build(m.where(f"id > 3000 and id <= {WATERMARK}")))
    return _six(recent.latest(entries, m, WATERMARK, DEVICE, limit=30), "value")


def _called(spark, sf_dir, call: str) -> DataFrame:
    """A call of a table function over the test tables."""
    m = measures(spark, sf_dir)
    plug, three = _windows(spark, sf_dir)
    table_functions.register(spark, measurements=m, rollup_hourly=rollup.build(m.where(F.col("id") <= WATERMARK), 3600), energy_plug=plug, energy_three_phase=three)
    return spark.sql(f"select * from {call}")


@query(SQL["history_raw_range_7min"])
def sql_history(spark, sf_dir):
    return _six(_called(spark, sf_dir, f"history('{DEVICE}', timestamp_ntz'2024-01-05', timestamp_ntz'2024-01-25 23:59:59.999999', 420)"), "value")


@query(SQL["history_from_rollup_6_hours"])
def sql_rolled_history(spark, sf_dir):
    return _six(_called(spark, sf_dir, f"rolled_history('{DEVICE}', timestamp_ntz'2024-01-02', timestamp_ntz'2024-01-29 23:59:59.999999', 21600, {WATERMARK})"), "value")


@query(SQL["latest_minute_snapshots"])
def sql_latest(spark, sf_dir):
    return _six(_called(spark, sf_dir, f"latest('{DEVICE}', 30)"), "value")


@query(SQL["energy_listing"])
def sql_energy(spark, sf_dir):
    out = _called(spark, sf_dir, "energy(timestamp_ntz'2024-01-03', timestamp_ntz'2024-01-27 23:59:59.999999', true)")
    return out.select("device_id", "device_type", "window_start", "window_end", "energy_wh", "a_energy_wh", "total_energy_wh")


@query(SQL["energy_totals_working"])
def sql_energy_totals(spark, sf_dir):
    return _three(_called(spark, sf_dir, "energy_totals(timestamp_ntz'2024-01-03', timestamp_ntz'2024-01-27 23:59:59.999999', true)"))
