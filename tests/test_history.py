"""History, rollups and retention on hand-made rows."""

from datetime import datetime, timedelta

import pytest

from heliogrid.functions.params import HistoryParams, energy_bounds, normalize_list, ordered_distinct, parse_bound, weather_bounds
from heliogrid.operators import history, rollup

M = "id long, device_id string, metric string, value double, unit string, event_time timestamp_ntz"
R = "device_id string, metric string, unit string, bucket_start timestamp_ntz, value_avg double, value_min double, value_max double, sample_count int"
T = datetime(2026, 7, 1)


def at(h, m, s=0):
    return T + timedelta(hours=h, minutes=m, seconds=s)


def avg(size, unit, start, end):
    return HistoryParams(start=start, end=end, aggregate="avg", bucket_unit=unit, bucket_size=size)


@pytest.mark.parametrize("size,unit,table", [(1, "minute", "raw"), (5, "minute", "5min"), (15, "minute", "5min"), (7, "minute", "raw"), (60, "minute", "hourly"), (1, "hour", "hourly"), (1, "day", "hourly")])
def test_route(size, unit, table):
    assert history.route(HistoryParams(aggregate="avg", bucket_unit=unit, bucket_size=size)) == table
    assert history.route(HistoryParams()) == "raw"


def test_interval_text():
    assert HistoryParams(aggregate="avg", bucket_unit="hour", bucket_size=6).interval == "6 hours" and HistoryParams(aggregate="avg", bucket_unit="day").interval == "1 day"


def test_rollup_and_tail(spark):
    made = spark.createDataFrame([("d", "t", "C", at(10, 0), 20.0, 10.0, 30.0, 3)], R)
    raw = spark.createDataFrame([(90, "d", "t", 30.0, "C", at(10, 4)), (101, "d", "t", 50.0, "C", at(10, 4, 30))], M)
    p = avg(15, "minute", "2026-07-01T10:00", "2026-07-01T10:14")
    assert [r.value for r in history.rollup_history(made, raw, 100, "d", p, T).collect()] == [27.5]
    assert [r.value for r in history.rollup_history(made, raw, None, "d", p, T).collect()] == [20.0]


def test_rebucketing_newest_first(spark):
    made = spark.createDataFrame([("d", "t", "C", at(12, 5 * k), float(k), float(k), float(k), 1) for k in range(12)], R)
    got = history.rollup_history(made, spark.createDataFrame([], M), 100, "d", avg(15, "minute", "2026-07-01T12:00", "2026-07-01T12:59"), T).collect()
    assert [r.value for r in got] == [10.0, 7.0, 4.0, 1.0]


def test_end_is_exclusive(spark):
    made = spark.createDataFrame([("d", "t", "C", datetime(2026, 7, d), v, v, v, 1) for d, v in ((29, 20.0), (30, 30.0))], R)
    got = history.rollup_history(made, spark.createDataFrame([], M), 0, "d", avg(1, "day", "2026-07-29T00:00", "2026-07-30T00:00"), T).collect()
    assert [r.value for r in got] == [20.0]


def test_null_values_and_times(spark):
    raw = spark.createDataFrame([(1, "d", "t", 10.0, "C", at(1, 0)), (2, "d", "t", None, "C", at(1, 0, 5)), (3, "d", "t", 4.0, "C", None)], M)
    made = rollup.build(raw, 300).collect()
    assert [(r.value_avg, r.sample_count) for r in made] == [(10.0, 1)]
    tail = history.rollup_history(spark.createDataFrame([], R), raw, 0, "d", avg(5, "minute", "2026-07-01", "2026-07-01"), T).collect()
    assert [r.value for r in tail] == [5.0]  # rows count in the tail, null or not
    assert [r.bucket for r in history.latest(raw, "d", limit=2).collect()] == [at(1, 0)]  # the null bucket takes a place
    assert history.latest(raw, "none").count() == 0


def test_two_units_in_a_bucket(spark):
    raw = spark.createDataFrame([(1, "d", "t", 1.0, "A", at(1, 0)), (2, "d", "t", 3.0, "B", at(1, 0, 1))], M)
    rows = history.latest(raw, "d")
    assert rows.count() == 2
    assert history.snapshots(rows).first().measurements["t"].unit == "B"


def test_late_rows_merge_and_replays(spark):
    rows = [(k, "d", "t", float(k), "C" if k % 2 else None, at(k % 3, k % 60)) for k in range(50)]
    raw = spark.createDataFrame(rows, M)
    out, last = rollup.build(raw.limit(0), 3600), -1
    while (b := rollup.next_batch(raw, last, 17)).count():
        out, last = rollup.merge(out, rollup.build(b, 3600)), rollup.advance(b, last)
    key = lambda d: sorted((r.bucket_start, round(r.value_avg, 9), r.value_min, r.value_max, r.sample_count) for r in d.collect())
    assert last == 49 and key(out) == key(rollup.build(raw, 3600))
    assert rollup.advance(raw.limit(0), 7) == 7
    with pytest.raises(ValueError):
        rollup.next_batch(raw, None, 5)


def test_seed_rebuilds_whole_buckets(spark):
    raw = spark.createDataFrame([(k, "d", "t", float(k), "C", at(0, 10 * k)) for k in range(12)], M)
    old = rollup.build(raw.where("id < 6"), 3600)
    now = at(1, 55)
    whole = {r.bucket_start: r.sample_count for r in rollup.seed(old, raw, 3600, now, timedelta(minutes=90)).collect()}
    cut = {r.bucket_start: r.sample_count for r in rollup.seed(old, raw, 3600, now, timedelta(minutes=90), aligned=False).collect()}
    assert whole == {at(0, 0): 6, at(1, 0): 6} and cut[at(0, 0)] < 6


def test_retention(spark):
    raw = spark.createDataFrame([(k, "d", "t", 1.0, "C", at(k, 0) if k != 2 else None) for k in range(10)], M)
    gone = rollup.doomed(raw, 6, at(9, 0), timedelta(hours=4), 3)
    assert [r.id for r in gone.collect()] == [0, 1, 3]
    left = rollup.survivors(raw, 6, at(9, 0), timedelta(hours=4), 3)
    assert sorted(r.id for r in left.collect()) == [2, 4, 5, 6, 7, 8, 9] and "Join" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in rollup.expire(raw, at(9, 0), timedelta(hours=4)).collect()) == [2, 5, 6, 7, 8, 9]
    with pytest.raises(ValueError):
        rollup.doomed(raw, None, T, timedelta(1), 3)


def test_parameters():
    assert parse_bound("2026-01-02", "end") == datetime(2026, 1, 2, 23, 59, 59, 999999)
    assert parse_bound("2026-01-02T03:04", "end") == datetime(2026, 1, 2, 3, 4)
    for bad in ({"start": "2026-01-01"}, {"start": "2026-01-02", "end": "2026-01-01"}, {"bucket_size": 3}, {"aggregate": "sum", "bucket_unit": "hour"}, {"aggregate": "avg", "bucket_unit": "week"}, {"limit": -1}, {"limit": 1001}):
        with pytest.raises(ValueError):
            HistoryParams(**bad)
    assert normalize_list([" b", "a", "", "a "]) == ["a", "b"] and normalize_list([" "]) is None
    assert ordered_distinct(" x_10,x_10, x_22 ") == ["x_10", "x_22"]
    for text in (" , ", "y"):
        with pytest.raises(ValueError):
            ordered_distinct(text, {"x"})
    assert weather_bounds(None, None, T.date())[1] == datetime(2026, 7, 7, 23, 59, 59, 999999)
    assert energy_bounds(None, "2026-07-01", at(5, 30))[0] == at(5, 0) - timedelta(hours=24)
