"""The endpoints as SQL table functions: ``select * from history('device-7', ...)``.

``register`` gives a session views of the stored tables and functions over them, in Spark's own SQL. A function's body is a
query that Catalyst inlines, so the arguments of a call reach the scan like literals and nothing runs row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliogrid.functions.timebucket import LOCAL_ZONE, ORIGIN, WORK_DAYS, WORK_FROM, WORK_TO

#: Fixed shape of the answers.
READINGS = "device_id string, metric string, unit string, bucket timestamp_ntz, value double"
ENERGY = "device_id string, device_type string, window_start timestamp_ntz, window_end timestamp_ntz, energy_wh double, a_energy_wh double, b_energy_wh double, c_energy_wh double, total_energy_wh double"

FUNCTIONS = {
    "time_bucket": f"""(ts timestamp_ntz, seconds bigint) returns timestamp_ntz
return timestampadd(MICROSECOND, -pmod(timestampdiff(MICROSECOND, timestamp_ntz'{ORIGIN}', ts), seconds * 1000000), ts)""",
    "is_working": f"""(ts timestamp_ntz) returns boolean
return weekday(convert_timezone('UTC', '{LOCAL_ZONE}', ts)) < {WORK_DAYS} and hour(convert_timezone('UTC', '{LOCAL_ZONE}', ts)) between {WORK_FROM} and {WORK_TO - 1}""",
    # averages over [since, until); without metrics all of them
    "history": f"""(device string, since timestamp_ntz, until timestamp_ntz, seconds bigint, metrics array<string> default null) returns table ({READINGS})
return select device_id, metric, unit, time_bucket(event_time, history.seconds) as bucket, avg(value) as value from measurements
where device_id = history.device and event_time >= history.since and event_time < history.until and (history.metrics is null or array_contains(history.metrics, metric)) group by 1, 2, 3, 4""",
    # weighted averages of hourly rollups up to the watermark and of raw rows past it
    "rolled_history": f"""(device string, since timestamp_ntz, until timestamp_ntz, seconds bigint, watermark bigint) returns table ({READINGS})
return select device_id, metric, max(unit) as unit, bucket, sum(total) / nullif(sum(n), 0) as value from (
select device_id, metric, unit, time_bucket(bucket_start, rolled_history.seconds) as bucket, value_avg * sample_count as total, sample_count as n from rollup_hourly
where device_id = rolled_history.device and bucket_start >= rolled_history.since and bucket_start < rolled_history.until
union all select device_id, metric, unit, time_bucket(event_time, rolled_history.seconds), value, 1 from measurements
where device_id = rolled_history.device and event_time >= rolled_history.since and event_time < rolled_history.until and id > rolled_history.watermark) group by 1, 2, 4""",
    # one-minute averages of the last minutes; the minutes of one device are ranked, not its rows
    "latest": f"""(device string, buckets bigint) returns table ({READINGS})
return with a as (select device_id, metric, unit, time_bucket(event_time, 60) as bucket, avg(value) as value from measurements where device_id = latest.device group by 1, 2, 3, 4),
r as (select bucket, row_number() over (order by bucket desc) as n from (select distinct bucket from a)) select a.* from a join r on a.bucket = r.bucket where r.n <= latest.buckets""",
    # windows wholly inside [since, until] of both kinds of meters
    "energy": f"""(since timestamp_ntz, until timestamp_ntz, working_only boolean default false, devices array<string> default null) returns table ({ENERGY})
return select device_id, 'plug', window_start, window_end, energy_wh, cast(null as double), cast(null as double), cast(null as double), cast(null as double) from energy_plug
where window_start >= energy.since and window_end <= energy.until and (not energy.working_only or is_working_day = 1 and is_working_hour = 1) and (energy.devices is null or array_contains(energy.devices, device_id))
union all select device_id, 'three_phase', window_start, window_end, null, a_energy_wh, b_energy_wh, c_energy_wh, total_energy_wh from energy_three_phase
where window_start >= energy.since and window_end <= energy.until and (not energy.working_only or is_working_day = 1 and is_working_hour = 1) and (energy.devices is null or array_contains(energy.devices, device_id))""",
    # one row a device of either kind
    "energy_totals": """(since timestamp_ntz, until timestamp_ntz, working_only boolean default false) returns table (device_id string, energy_wh double)
return select device_id, coalesce(sum(coalesce(energy_wh, total_energy_wh)), 0) from energy(energy_totals.since, energy_totals.until, energy_totals.working_only) group by 1""",
}
TABLES = ("measurements", "rollup_hourly", "energy_plug", "energy_three_phase")


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """Views of TABLES and the functions over them, for this session; functions over tables that aren't given are left out."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"no table {name}")
        df.createOrReplaceTempView(name)
    for name, body in FUNCTIONS.items():
        needs = {t for t in TABLES if f" {t}" in body.replace("energy_totals", "")} | ({"energy_plug", "energy_three_phase"} if name == "energy_totals" else set())
        if needs <= set(tables):
            spark.sql(f"create or replace temporary function {name}{body}")
