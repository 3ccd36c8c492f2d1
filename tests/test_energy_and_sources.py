"""Energy, fleet, registry, messages, forecasts and runs on hand-made rows; streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heliogrid.functions.timebucket import working_flags
from heliogrid.operators import energy, fleet, history, pv, rollup, rollup_job, runs
from heliogrid.operators.rollup_job import RollupStore
from heliogrid.operators.upsert import VersionedTable, cascade, checked, merge_registry
from heliogrid.sources import forecast, messages

M = "id long, device_id string, metric string, value double, unit string, event_time timestamp_ntz"
T = datetime(2026, 7, 1, 10)
MSG = "topic string, payload string, ingestion_time timestamp_ntz"


def at(m, s=0):
    return T + timedelta(minutes=m, seconds=s)


def test_counter(spark):
    rows = [(1, "one", "t", 7.0, "Wh", at(5)), (2, "two", "t", 5.0, "Wh", at(1)), (3, "two", "t", None, "Wh", at(2)), (4, "two", "t", 8.5, "Wh", at(50)), (5, "two", "t", 9.0, "Wh", at(50)), (6, "reset", "t", 9.0, "Wh", at(1)), (7, "reset", "t", 2.0, "Wh", at(9))]
    got = {r.device_id: r.energy_wh for r in energy.counter_delta(spark.createDataFrame(rows, M)).collect()}
    assert got == {"one": 0.0, "two": 4.0}


def test_phases(spark):
    rows, i = [], 0
    for m, values in ((0, (60.0, 0.0, 30.0)), (30, (60.0, None, 30.0)), (59, (120.0, 10.0, 30.0)), (61, (900.0, 900.0, 900.0))):
        for p, v in zip(energy.PHASES.values(), values):
            if v is not None:
                rows.append((i := i + 1, "d", p, v, "W", at(m)))
    rows.append((99, "single", "a_act_power", 1.0, "W", at(3)))
    got = energy.phase_energy(spark.createDataFrame(rows, M)).collect()
    assert len(got) == 1 and got[0].window_start == T  # nothing crosses the hour; one time gives no row
    a = 60 * 0.5 + 90 * 29 / 60
    assert (got[0].a_energy_wh, got[0].b_energy_wh, got[0].c_energy_wh) == (round(a, 3), 0.0, round(30 * 59 / 60, 3))
    assert got[0].total_energy_wh == round(a + 30 * 59 / 60, 3)


def test_working_flags_over_a_year(spark):
    from zoneinfo import ZoneInfo

    hours = spark.range(8760).select(F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).alias("t"))
    day, hour = working_flags(F.col("t"))
    for r in hours.select("t", day.alias("d"), hour.alias("h")).collect():
        local = r.t.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo("Europe/Athens"))
        d = local.weekday() < 5
        assert (r.d, r.h) == (int(d), int(d and 8 <= local.hour < 14))


def test_windows_inside_bounds(spark):
    rows = energy.with_window(spark.createDataFrame([("d", datetime(2026, 7, 1, h), 1.0) for h in (0, 22, 23)], "device_id string, window_start timestamp_ntz, energy_wh double"))
    got = energy.select_windows(rows, datetime(2026, 7, 1), datetime(2026, 7, 1, 23, 59, 59, 999999))
    assert got.count() == 2  # the last hour ends on the next day
    assert energy.totals(got.limit(0), ["energy_wh"], per_device=False).first().energy_wh == 0.0
    assert energy.totals(got.limit(0), ["energy_wh"]).count() == 0
    with pytest.raises(ValueError):
        energy.split_devices(["other-1"])


def test_fleet(spark):
    env = spark.createDataFrame([(f"e{k}",) for k in range(1, 6)], "device_id string")
    met = spark.createDataFrame([(f"m{k}",) for k in range(1, 4)], "device_id string")
    seen = spark.createDataFrame([(f"e{k}", at(-5)) for k in range(1, 5)] + [("e5", at(-120)), ("m1", at(-5)), ("m2", at(-5)), ("e1", at(-900))], "device_id string, event_time timestamp_ntz")
    r = fleet.status([fleet.last_seen(env, seen, "environmental"), fleet.last_seen(met, seen, "meter")], T).first()
    assert (r.total, r.live, r.stale, r.offline, r.environmental, r.meter, r.availability) == (8, 6, 1, 1, 5, 3, 75.0)
    r = fleet.status([fleet.last_seen(env.limit(0), seen, "environmental")], T).first()
    assert r.total == 0 and r.availability is None and r.latest_reading_at is None


def test_registry(spark):
    schema = "device_id string, dev_eui string, name string, at int"
    merge = lambda old, new: merge_registry(old, spark.createDataFrame(new, schema), ["device_id"], ["dev_eui"], ["name"], ["at"])
    none = spark.createDataFrame([], schema + ", name_at int")
    batches = [[("a", "E1", "Alpha", 1), ("b", "E2", None, 5)], [("a", None, None, 2), ("c", "E3", "C", 2), ("c", "E4", None, 3), ("b", "E1", "B", 4)]]
    for first, second in (batches, batches[::-1]):  # the order of batches doesn't count
        got = {r.device_id: (r.dev_eui, r.name) for r in merge(merge(none, first), second).collect()}
        assert got == {"a": (None, "Alpha"), "b": ("E2", "B"), "c": ("E4", "C")}


def test_constraints_and_cascade(spark):
    rows = spark.createDataFrame([(1, 5), (2, 30)], "run_id int, h int")
    with pytest.raises(Exception, match="hour"):
        checked(rows, hour="h between 0 and 23").collect()
    assert checked(rows, run="run_id > 0").count() == 2
    assert cascade(rows, spark.createDataFrame([(2,)], "id int"), "run_id").count() == 1


def meter(topic, payload):
    return (topic, payload if isinstance(payload, str) else json.dumps(payload), T)


METERS = [
    meter("plug-1/status/switch:0", {"apower": 12, "aenergy": {"total": 5.5, "minute_ts": 1782900000}, "ret_aenergy": {"total": True}}),
    meter("em-1/status/em:0", {"total_current": 1.5, "a_act_power": "7", "b_act_power": 2.25, "total_aprt_power": False}),
    meter("plug-1/status/x", "not json"),
    meter("plug-1/status/x", [1, 2]),
    meter("plug-1/online", {"apower": 1}),
    meter("/status/x", {"apower": 1}),
]


def test_meter_messages(spark):
    parsed = messages.meter_messages(spark.createDataFrame(METERS, MSG))
    got = {(r.device_id, r.metric): (r.value, r.unit) for r in messages.meter_measurements(parsed).collect()}
    assert got == {("plug-1", "apower"): (12.0, "W"), ("plug-1", "aenergy_total"): (5.5, "Wh"), ("em-1", "total_current"): (1.5, "A"), ("em-1", "b_act_power"): (2.25, "W")}
    rows = parsed.collect()
    assert len(rows) == 4 and any(json.loads(r.payload) == {"raw_payload": "not json"} for r in rows)
    assert {r.event_time for r in rows} == {T, datetime(2026, 7, 1, 10)} or datetime.utcfromtimestamp(1782900000) in {r.event_time for r in rows}


def test_environmental_messages(spark):
    up = {"end_device_ids": {"device_id": "n1", "dev_eui": "EE"}, "received_at": "2026-07-01T10:00:00.123456789Z", "uplink_message": {"decoded_payload": {"environmental": {"temperature": 21.5, "relative_humidity": "40"}, "co2": {"co2": 400}, "voc_index": {"voc": 3}, "pm_MC": {"pm1": 1, "pm25": 2, "pm4": 3, "pm10": None}}}}
    rows = [("t", json.dumps(x), T) for x in (up, {"end_device_ids": {"device_id": ""}}, {"end_device_ids": {"device_id": "n2"}})]
    parsed = messages.environmental_messages(spark.createDataFrame(rows, MSG))
    got = {r.metric: (r.value, r.unit) for r in messages.environmental_measurements(parsed).collect()}
    assert got == {"temperature": (21.5, "C"), "relative_humidity": (40.0, "%"), "co2": (400.0, "ppm"), "voc": (3.0, None), "pm1": (1.0, "ug/m3"), "pm25": (2.0, "ug/m3"), "pm4": (3.0, "ug/m3")}
    first = parsed.where("device_id = 'n1'").first()
    assert first.event_time == datetime(2026, 7, 1, 10, 0, 0, 123456) and first.dev_eui == "EE" and parsed.count() == 2


def test_forecast_arrays(spark):
    names = {"cloud_cover": "cloud_cover_percent"}
    make = lambda x: spark.createDataFrame([x], forecast.schema(list(names)))
    good = make((1.0, 2.0, "UTC", (["2026-07-01T00:00", "2026-07-01T01:00"], [5.0, None])))
    got = forecast.hourly_rows(good, names).collect()
    assert [(r.forecast_hour, r.cloud_cover_percent) for r in got] == [(0, 5.0), (1, None)]
    with pytest.raises(Exception, match="length"):
        forecast.hourly_rows(make((1.0, 2.0, "UTC", (["2026-07-01T00:00"], [5.0, 6.0]))), names).collect()


def test_pv(spark):
    rows = spark.createDataFrame([(datetime(2026, 7, d, h), g) for d in (1, 2) for h, g in ((0, 0.0), (12, 20.0), (13, None))], "forecast_timestamp timestamp_ntz, ghi double")
    day = pv.second_date(pv.features(rows, 3.0))
    assert [r.lag_1h for r in day.orderBy("forecast_timestamp").collect()] == [0.0, 3.0, 3.0]
    scored = pv.clip_and_mask(pv.score(day.fillna(-1.0, ["ghi"]), ["ghi"], lambda x: x["ghi"] + 1), "raw_kw", "ghi")
    assert [r.predicted_power_kw for r in scored.orderBy("forecast_timestamp").collect()] == [0.0, 21.0, 0.0]
    masked = pv.clip_and_mask(day.withColumn("raw_kw", F.lit(2.0)), "raw_kw", "ghi").orderBy("forecast_timestamp").collect()
    assert [r.predicted_power_kw for r in masked] == [0.0, 2.0, 2.0]
    with pytest.raises(ValueError):
        pv.second_date(rows.where("day(forecast_timestamp) = 1"))


def test_run_responses(spark):
    body = {"status": "ok", "run_id": "x", "day_ahead_date": "2026-07-02", "summary": {"requested_rooms": 2, "failed_rooms": "1.5"}, "school_totals": [], "hourly_load": {"h": 1}, "room_results": [{"room_id": "a", "status": "failed", "error": "e"}, {"room_id": "a", "status": "success", "metrics": {"facility_kwh": 1.25}}]}
    rows = spark.createDataFrame([(1, json.dumps(body)), (2, "{}")], "run_id int, response_json string")
    r = {x.run_id: x for x in runs.run_columns(rows).collect()}
    assert r[1].requested_rooms == 2 and r[1].failed_rooms is None and r[1].facility_kwh is None and json.loads(r[1].hourly_load) == {"h": 1} and r[2].hourly_load is None
    rooms = runs.room_results(rows).collect()
    assert len(rooms) == 1 and rooms[0].status == "success" and float(rooms[0].facility_kwh) == 1.25 and rooms[0].error_text is None
    table = spark.createDataFrame([(1, True, datetime(2026, 1, 1), None), (2, True, datetime(2026, 1, 2), T), (3, False, datetime(2026, 1, 3), T)], "id int, success boolean, started_at timestamp_ntz, completed_at timestamp_ntz")
    assert runs.latest_successful(table).first().id == 2 and runs.successful_run_id(table).first().id == 2
    both = runs.with_children(runs.latest_successful(table), rooms and spark.createDataFrame([(9, "x")], "run_id int, room string"), "run_id")
    assert both.count() == 1 and both.first().room is None


def test_commit_rewrites_touched_days_only(spark, tmp_path):
    rows = spark.createDataFrame([(k, "d", "t", float(k), "C", T + timedelta(days=k % 3, minutes=k)) for k in range(1, 40)], M)
    store = RollupStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="seed"):
        rollup_job.run_batch(store, rows)
    assert rollup_job.initialize(store, rows.where("id <= 20"), T + timedelta(days=4), timedelta(days=30)) == 20 == store.last_id()
    late = rows.where("id > 20 and day(event_time) = 1")
    stats = rollup_job.run_batch(store, late, 100)
    assert stats == {"n_rows": late.count(), "first_id": 21, "last_id": store.last_id()}
    versions = {(r["name"], r["day"]): r["version"] for r in store._manifest() if r["day"]}
    assert {v for (_, d), v in versions.items() if d == "2026-07-01"} == {2} and {v for (_, d), v in versions.items() if d != "2026-07-01"} == {1}
    spark.range(5).write.parquet(str(tmp_path / "s" / "data" / "v3" / "5min" / "day=2026-07-01"))  # a job that died before its commit
    assert store.table("5min").agg(F.sum("sample_count")).first()[0] == 20 + late.count()
    assert rollup_job.run_batch(store, late)["n_rows"] == 0 and store.manifests.version() == 2
    rest = rows.withColumn("id", F.col("id") + 100).where("id > 120 and day(event_time) <> 1")
    assert rollup_job.run(store, rest, 7) == rest.count()
    both = rows.where("id <= 20").unionByName(late).unionByName(rest)
    for name, stride in rollup.STRIDES.items():
        key = lambda d: sorted((r.bucket_start, r.metric, round(r.value_avg, 9), r.sample_count) for r in d.collect())
        assert key(store.table(name)) == key(rollup.build(both, stride))
    assert store.vacuum() and key(store.table("hourly")) == key(rollup.build(both, 3600))


def test_energy_of_named_devices(spark):
    plug = energy.with_window(spark.createDataFrame([("shellyplug-1", T, 1.5), ("shellyplug-2", T, 9.0)], "device_id string, window_start timestamp_ntz, energy_wh double"))
    three = energy.with_window(spark.createDataFrame([("shellypro3em-1", T, 1.0, 2.0, 3.0, 6.0)], "device_id string, window_start timestamp_ntz, a_energy_wh double, b_energy_wh double, c_energy_wh double, total_energy_wh double"))
    day = (datetime(2026, 7, 1), datetime(2026, 7, 2))
    ids = ["shellypro3em-1", "shellyplug-1", "shellyplug-9"]
    assert [r.device_id for r in energy.listing_of(ids, plug, three, *day).collect()] == ["shellyplug-1", "shellypro3em-1"]
    got = energy.totals_of(ids, plug, three, *day).collect()
    assert [(r.device_id, r.energy_wh, r.total_energy_wh) for r in got] == [("shellypro3em-1", None, 6.0), ("shellyplug-1", 1.5, None), ("shellyplug-9", 0.0, None)]
    with pytest.raises(ValueError):
        energy.totals_of(["other-1"], plug, three, *day)
    late = energy.refresh(plug, spark.createDataFrame([(1, "shellyplug-1", "t", 1.0, "Wh", at(1)), (2, "shellyplug-1", "t", 5.0, "Wh", at(9))], M), energy.counter_delta)
    assert {r.device_id: r.energy_wh for r in late.collect()} == {"shellyplug-1": 4.0, "shellyplug-2": 9.0}


def test_replayed_batch_rewrites_its_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3), 0)
    spark.range(99).write.parquet(str(tmp_path / "t" / "v2"))  # a crash after the data, before the pointer
    assert table.read().count() == 3
    table.write(table.read().union(spark.range(2)), 1)
    assert table.read().count() == 5 and table.has_batch(1) and not table.has_batch(2)
