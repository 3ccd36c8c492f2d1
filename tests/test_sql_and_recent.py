"""Table functions in SQL, and the kept minutes."""

import random
from datetime import datetime, timedelta

import pytest

from heliogrid.operators import energy, history, recent, rollup
from heliogrid.plans import sql

M = "id long, device_id string, metric string, value double, unit string, event_time timestamp_ntz"
T = datetime(2026, 7, 1, 10)


def rows_of(spark, n, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(k, rng.choice("aab"), rng.choice("xy"), rng.choice([None, 1.0, 2.5, 4.0]), rng.choice([None, "C"]), T + timedelta(seconds=rng.randint(0, 3000)) if rng.random() < 0.95 else None) for k in range(n)], M)


def key(df):
    return sorted((r.device_id, r.metric, str(r.unit), r.bucket, None if r.value is None else round(r.value, 9)) for r in df.collect())


def test_kept_minutes_answer_like_all_rows(spark):
    rows = rows_of(spark, 400)
    entries = None
    for low in range(0, 300, 75):
        new = recent.build(rows.where(f"id >= {low} and id < {low + 75}"), 40)
        entries = new if entries is None else recent.merge(entries, new, 40)
    assert max(len(r.minutes) for r in entries.collect()) == 40
    times = rows.where("event_time is not null")
    for device in ("a", "b", "none"):
        for metrics in (None, ["x"]):
            got = key(recent.latest(entries, rows, 299, device, metrics, limit=12))
            assert got == key(history.latest(times, device, metrics, limit=12))
    assert recent.build(rows.limit(0)).count() == 0 and recent.latest(recent.build(rows.limit(0)), rows, 10**9, "a").count() == 0


def test_an_old_late_row_is_no_last_minute(spark):
    rows = spark.createDataFrame([(k, "a", "x", float(k), "C", T + timedelta(minutes=k)) for k in range(20)], M)
    late = spark.createDataFrame([(90, "a", "x", 7.0, "C", T - timedelta(days=3)), (91, "a", "x", 100.0, "C", T + timedelta(minutes=19))], M)
    entries = recent.merge(recent.build(rows, 5), recent.build(late, 5), 5)
    got = recent.latest(entries, rows.limit(0), 99, "a", limit=3).collect()
    assert [r.value for r in got] == [59.5, 18.0, 17.0]


def test_table_functions_and_their_arguments(spark, tmp_path):
    rows_of(spark, 300).write.parquet(str(tmp_path / "m"))
    rows = spark.read.schema(M).parquet(str(tmp_path / "m"))
    plug = energy.with_window(spark.createDataFrame([("shellyplug-1", T, 1.5), ("shellyplug-2", T, 9.0)], "device_id string, window_start timestamp_ntz, energy_wh double"))
    sql.register(spark, measurements=rows, energy_plug=plug, energy_three_phase=energy.phase_energy(rows.limit(0)))
    until = "timestamp_ntz'2026-07-02'"
    call = f"select * from history('a', timestamp_ntz'2026-07-01', {until}, 600, array('x'))"
    assert key(spark.sql(call)) == key(history.averages(rows.where("device_id = 'a' and metric = 'x' and event_time is not null"), 600))
    plan = spark.sql(call)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(device_id,a)" in plan and "PushedFilters: [IsNotNull" in plan and "GreaterTha" in plan and "Python" not in plan
    assert key(spark.sql("select * from latest('b', 4)")) == key(history.latest(rows.where("event_time is not null"), "b", limit=4))
    assert [r.energy_wh for r in spark.sql(f"select * from energy(timestamp_ntz'2026-07-01', {until}, devices => array('shellyplug-2'))").collect()] == [9.0]
    assert {r.device_id: r.energy_wh for r in spark.sql(f"select * from energy_totals(timestamp_ntz'2026-07-01', {until})").collect()} == {"shellyplug-1": 1.5, "shellyplug-2": 9.0}
    with pytest.raises(ValueError, match="odd"):
        sql.register(spark, odd=rows)
    sql.register(spark, rollup_hourly=rollup.build(rows, 3600), measurements=rows)
    assert spark.sql(f"select * from rolled_history('a', timestamp_ntz'2026-07-01', {until}, 3600, 1000)").count() == rollup.build(rows.where("device_id = 'a'"), 3600).count()
