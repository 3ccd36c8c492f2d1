import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from heliogrid.functions.params import non_negative, required_text, resolve
from heliogrid.functions.safe import date_at, date_or_null, decimal_or_null, int_at, int_or_null
from heliogrid.operators import pv, runs
from heliogrid.sources import forecast, landed


def test_requests():
    days = landed.horizon(date(2026, 8, 8))
    assert days[0] == date(2026, 8, 8) and days[-1] == date(2026, 8, 15) and len(days) == 8
    r = landed.weather_request(38.2, 21.7, "Europe/Athens", date(2026, 8, 8))
    assert r["end_date"] == "2026-08-15" and len(r["hourly"].split(",")) == 13
    assert len(landed.pv_request(1.0, 2.0)["hourly"].split(",")) == 6
    assert landed.day_ahead_request("x_1", date(2026, 8, 8)) == {"school_id": "x_1", "target_date": "2026-08-09"}
    assert r["wind_speed_unit"] == "ms"


def test_landed_payload(spark, tmp_path):
    hours = [f"2026-08-08T{h:02d}:00" for h in range(3)]
    body = {"latitude": 1.5, "longitude": 2.5, "timezone": "UTC", "hourly": {"time": hours} | {v: [1.0, None, 3.0] for v in forecast.WEATHER}}
    (tmp_path / "a.json").write_text(json.dumps(body))
    request = landed.weather_request(38.2466, 21.7346, "Europe/Athens", date(2026, 8, 8))
    first, later = datetime(2026, 8, 8, 6), datetime(2026, 8, 8, 7)
    rows = landed.weather_payloads(spark, str(tmp_path), request, first)
    assert rows.count() == 3 and set(forecast.WEATHER.values()) <= set(rows.columns)
    # the answer is computed for its own place, the row is keyed by the one asked for
    assert {(r.latitude, r.longitude, r.timezone) for r in rows.collect()} == {(Decimal("38.246600"), Decimal("21.734600"), "Europe/Athens")}
    newer = landed.weather_payloads(spark, str(tmp_path), request, later).where("forecast_hour <= 1").withColumn("cloud_cover_percent", F.lit(9).cast("decimal(18,6)"))
    newer = newer.withColumn("forecast_timestamp", F.expr("forecast_timestamp + interval 1 hour"))  # hours 1 and 2
    merged = {r.forecast_timestamp.hour: r for r in forecast.upsert_weather(rows, newer).collect()}
    assert [merged[h].cloud_cover_percent for h in range(3)] == [1, 9, 9]
    assert [(merged[h].created_at, merged[h].updated_at, merged[h].fetched_at) for h in range(3)] == [(first, first, first), (first, later, later), (first, later, later)]
    assert forecast.upsert_weather(rows.limit(0), rows).count() == 3
    assert forecast.nearest_future(rows, datetime(2026, 8, 8, 1, 40)).first().forecast_hour == 1
    assert landed.health(spark)
    kept = rows.orderBy("forecast_hour").collect()
    assert kept[0].source == "open-meteo" and kept[0].weather_code == 1 and kept[1].weather_code is None and json.loads(kept[0].raw_request) == request
    assert json.loads(kept[1].raw_values) == {v: None for v in forecast.WEATHER}
    for broken in ([], None):
        bad = spark.createDataFrame([(1.0, 2.0, "UTC", (broken, [1.0]))], forecast.schema(["cloud_cover"]))
        with pytest.raises(Exception, match="no times"):
            forecast.hourly_rows(bad, {"cloud_cover": "c"}).collect()


def test_day_ahead_answers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"run_id": 4, "response_json": json.dumps({"status": "ok", "day_ahead_date": "2026-07-02"})}))
    row = runs.run_columns(landed.day_ahead_answers(spark, str(tmp_path))).first()
    assert (row.run_id, row.status, row.day_ahead_date) == (4, "ok", date(2026, 7, 2))


def test_measurements_push_down(spark, tmp_path):
    rows = [(1, "d", "t", 1.0, "C", datetime(2026, 1, 1))]
    spark.createDataFrame(rows, landed.MEASUREMENTS).write.parquet(str(tmp_path / "m"))
    df = landed.measurements(spark, str(tmp_path / "m")).where("device_id = 'd' and event_time >= timestamp_ntz'2025-01-01 00:00:00'").select("value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(device_id,d)" in plan and "GreaterThanOrEqual(event_time" in plan and "metric" not in plan.split("ReadSchema")[1]


def test_run_states(spark):
    old = spark.createDataFrame([(4, "a", None, None, None)], "id int, school string, success boolean, http_status int, error_text string")
    new = runs.create(old, spark.createDataFrame([("c",), ("b",)], "school string"))
    assert {r.school: r.id for r in new.collect()} == {"b": 5, "c": 6}
    done = old.select("id").withColumns(runs.failed(503, "late"))
    assert runs.finish(old.unionByName(new, allowMissingColumns=True), done).where("id = 4").first().error_text == "late"
    assert runs.finish(old, done.limit(0)).first().success is None


def test_pv_records(spark):
    rows = spark.createDataFrame([(datetime(2026, 7, 2, h), float(h), None) for h in (0, 1)], "forecast_timestamp timestamp_ntz, predicted_power_kw double, x double")
    got = pv.hourly_records(rows, 3, ["x"]).orderBy("forecast_hour").collect()
    assert [r.forecast_hour for r in got] == [0, 1] and json.loads(got[0].raw_features) == {"x": None}
    assert list(pv.report(rows)) == ["2026-07-02 00:00  0.00 kW", "2026-07-02 01:00  1.00 kW", "daily energy 1.00 kWh"]
    days = spark.createDataFrame([(datetime(2026, 7, d, h), 1.0) for d in (1, 2, 3) for h in range(24)], "forecast_timestamp timestamp_ntz, predicted_power_kw double")
    assert len(list(pv.report(days))) == 73 and list(pv.report(days))[-1] == "daily energy 72.00 kWh"
    hours = pv.pv_response(pv.hourly_records(rows, 3, ["x"])).first()
    assert hours.run_id == 3 and [(h.hour, h.predicted_power_kw) for h in hours.hours] == [(0, 0.0), (1, 1.0)]


def test_safe_casts(spark):
    rows = spark.createDataFrame([("3",), ("3.9",), ("x",), ("2026-01-02T05",), ("2026-01-02",), ("20260102",), ("2026",), ("2026-02-30",), (None,)], "t string")
    got = rows.select(int_or_null(F.col("t")), decimal_or_null(F.col("t")).cast("double"), date_or_null(F.col("t"))).collect()
    day = date(2026, 1, 2)
    assert [tuple(r) for r in got] == [(3, 3.0, None), (None, 3.9, None), (None, None, None), (None, None, None), (None, None, day), (20260102, 20260102.0, day), (2026, 2026.0, None), (None, None, None), (None, None, None)]
    numbers = spark.createDataFrame([(3.9, 7, True), (-3.9, None, False), (float("nan"), -1, None)], "d double, i int, b boolean")
    assert [tuple(r) for r in numbers.select(*[int_or_null(F.col(c)) for c in "dib"]).collect()] == [(3, 7, 1), (-3, None, 0), (None, -1, None)]
    json_ = spark.range(1).select(F.parse_json(F.lit('{"a": 3.9, "b": "3.9", "c": " 4 ", "d": true, "e": null, "f": [], "g": 2026, "h": "2026-01-02"}')).alias("v"))
    assert list(json_.select(*[int_at(F.col("v"), f"$.{c}") for c in "abcdefx"]).first()) == [3, None, 4, 1, None, None, None]
    assert list(json_.select(*[date_at(F.col("v"), f"$.{c}") for c in "gh"]).first()) == [None, day]


def test_rooms_of_a_run_are_replaced(spark):
    room = lambda i, s: {"room_id": i, "status": s, "metrics": {"facility_kwh": 1}}
    answer = lambda run, *rooms: (run, json.dumps({"room_results": list(rooms)}))
    first = spark.createDataFrame([answer(1, room("a", "ok"), room("b", "ok")), answer(2, room("c", "ok"))], "run_id long, response_json string")
    again = spark.createDataFrame([answer(1, room("b", "old"), room("b", "new"))], "run_id long, response_json string")
    rooms = runs.record_rooms(runs.room_results(first), again)
    assert sorted((r.run_id, r.room_id, r.status) for r in rooms.collect()) == [(1, "b", "new"), (2, "c", "ok")]


def test_answers_are_taken_apart_in_steps(spark):
    """Whatever the number of columns, the plan holds one piece of code for all totals, and rooms that go are not cast; odd answers give nulls."""
    odd = ["x", None, "3", "[]", '{"summary": [1], "school_totals": 3, "hourly_load": [1], "status": {"a": 1}, "room_results": {"a": 1}}', '{"summary": {"requested_rooms": "7_0", "successful_rooms": 3.9, "failed_rooms": true}, "school_totals": {"facility_kwh": " 1.5 ", "cooling_kwh": [1], "lighting_kwh": null}, "room_results": [3, null, {"room_id": 1, "metrics": [1]}, {"room_id": "1", "error": "e", "metrics": {"facility_kwh": "2.5"}}]}']
    rows = spark.createDataFrame(list(enumerate(odd)), "run_id long, response_json string").repartition(2)
    answers, rooms = runs.run_columns(rows), runs.room_results(rows)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as decimal(38,18)") == 1
    plan = rooms._jdf.queryExecution().optimizedPlan().toString()
    assert "as decimal(38,18)" not in plan[plan.index("Aggregate") :]  # numbers are read of the rooms that are left
    got = {r.run_id: r for r in answers.collect()}
    assert all(v is None for k in range(4) for n, v in got[k].asDict().items() if n not in ("run_id", "response_json"))
    assert got[4].status == '{"a":1}' and [got[4][n] for n in (*runs.ROOMS, *runs.TOTALS, "hourly_load")] == [None] * 10
    assert [got[5][n] for n in (*runs.ROOMS, "facility_kwh", "cooling_kwh", "lighting_kwh")] == [70, 3, 1, Decimal("1.5"), None, None]
    assert sorted((r.run_id, r.room_id, r.error_text, r.facility_kwh) for r in rooms.where("room_id is not null").collect()) == [(5, "1", "e", Decimal("2.5"))]
    assert rooms.where("room_id is null").count() == 1


def test_recording_response(spark):
    kinds = ["id int", "run_id int", "school_id string", "recording_date date", "room_id string", "label string", "physical_instance_count int", "idf_file string", "zone_name string", "thermostat_type string", "supports_cooling_setpoint boolean", "default_occupancy string", *[f"default_{d} decimal(6,2)" for d in runs.DEFAULTS[1:]], "raw_item string", "created_at timestamp_ntz", "updated_at timestamp_ntz"]
    row = (1, 2, "s", date(2026, 7, 2), "a", "A", 3, "f", "z", "t", True, "o", Decimal("20.50"), None, None, None, "{}", datetime(2026, 7, 2), None)
    got = runs.recording_response(spark.createDataFrame([row], ", ".join(kinds))).first().response
    assert got.supports.cooling_setpoint and got.defaults.heating_setpoint == 20.5 and got.defaults.cooling_setpoint is None and got.defaults.occupancy == "o"


def test_pv_payload(spark, tmp_path):
    body = {"latitude": 1.5, "longitude": 2.5, "timezone": "UTC", "hourly": {"time": ["2026-08-08T00:00"]} | {v: [1.0] for v in landed.PV_VARIABLES}}
    (tmp_path / "a.json").write_text(json.dumps(body))
    assert set(landed.PV_VARIABLES) <= set(landed.pv_payloads(spark, str(tmp_path)).columns)


def test_day_ahead_response(spark):
    run = spark.createDataFrame([(1, "s", date(2026, 7, 2), "ok", "e", "x", 2, 1, 1, *[1.5] * 6, "{}"), (2, "s", None, "ok", "e", "y", None, None, None, *[None] * 6, None)], "id int, school_id string, day_ahead_date date, status string, simulation_engine string, external_run_id string, requested_rooms long, successful_rooms long, failed_rooms long, " + ", ".join(f"{n} double" for n in runs.TOTALS) + ", hourly_load string")
    rooms = spark.createDataFrame([(1, "b", "B", "failed", "no", *[None] * 8), (1, "a", "A", "success", None, *[2.0] * 8)], "run_id int, room_id string, room_label string, status string, error_text string, " + ", ".join(f"{n} double" for n in runs.ROOM))
    got = {r.response.id: r.response for r in runs.day_ahead_response(run, rooms).collect()}
    assert [(x.room_id, x.error, x.metrics and x.metrics.facility_kwh) for x in got[1].room_results] == [("a", None, 2.0), ("b", "no", None)]
    assert got[1].school_totals.facility_kwh == 1.5 and got[1].summary.requested_rooms == 2 and got[2].room_results == []


def test_settings():
    assert resolve(None, 2.0, default=1.0) == 2.0 and resolve(None, default=1.0) == 1.0
    assert non_negative(" ", "x") is None and non_negative("2", "x") == 2.0
    with pytest.raises(ValueError):
        non_negative("-1", "x")
    with pytest.raises(ValueError):
        required_text(" ", "school")



def test_artefact_says_the_order_of_features(spark, tmp_path):
    from pyspark import cloudpickle

    from heliogrid.operators import artefact

    class Tiny:
        def __init__(self, names):
            self.feature_names_in_ = names

        def predict(self, x):
            assert list(x.columns) == ["b", "a"]
            return x["b"] * 10 + x["a"]

    def save(name, thing):
        (tmp_path / name).write_bytes(cloudpickle.dumps(thing))
        return str(tmp_path / name)

    rows = spark.createDataFrame([(1.0, 2.0, "x"), (3.0, None, "y")], "a double, b double, other string")
    got = artefact.score(rows, save("tiny.pkl", Tiny(["b", "a"]))).collect()
    assert [r.raw_kw for r in got] == [21.0, None] and got[0].other == "x"
    assert [r.raw_kw for r in artefact.score(rows, save("named.pkl", Tiny(None)), save("names.pkl", ["b", "a"])).collect()] == [21.0, None]
    with pytest.raises(KeyError, match="wind"):
        artefact.score(rows, save("more.pkl", Tiny(["b", "wind"])))
    with pytest.raises(LookupError, match="no features"):
        artefact.score(rows, save("none.pkl", Tiny(None)))
    with pytest.raises(TypeError, match="str"):
        artefact.score(rows, save("odd.pkl", Tiny(None)), save("text.pkl", "b,a"))
