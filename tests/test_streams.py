"""The message log and what streams make of it: ingest, registry, rollups, liveness; stored retention, touched windows, rounding."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliogrid.functions.params import HistoryParams
from heliogrid.functions.rounding import round_exact
from heliogrid.operators import energy, history, retention, rollup, rollup_job
from heliogrid.plans import catalogue
from heliogrid.sources import message_log
from heliogrid.sources.message_log import Log
from heliogrid.streaming import ingest, liveness
from tests.compare import same

M = "id long, device_id string, metric string, value double, unit string, event_time timestamp_ntz"
MSG = "topic string, payload string, ingestion_time timestamp_ntz"
T = datetime(2026, 7, 1, 10)


def at(m, s=0):
    return T + timedelta(minutes=m, seconds=s)


def meter(device, value, minute):
    return (f"{device}/status/x", json.dumps({"apower": value, "aenergy": {"total": 1, "minute_ts": 1782900000 + 60 * minute}}), at(minute))


def uplink(device, eui, minute):
    return ("up", json.dumps({"end_device_ids": {"device_id": device, "dev_eui": eui}, "received_at": "2026-07-01T10:00:00Z"}), at(minute))


def land(spark, folder, rows, parts=2):
    return message_log.append(spark.createDataFrame(rows, MSG).repartition(parts), folder)


def read(spark, folder, **options):
    message_log.register(spark)
    return spark.read.format(message_log.NAME).options(**options).load(folder)


def test_log_gives_each_message_once_however_it_is_cut(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert read(spark, folder).count() == 0
    rows = [("t", "é" * (k % 50) + str(k), at(k)) for k in range(200)] + [(None, None, None)]
    land(spark, folder, rows[:120])
    end = land(spark, folder, rows[120:], 3)
    assert end == Log(folder).end() == sum(os.path.getsize(tmp_path / "log" / f) for f in os.listdir(folder) if f.endswith(".jsonl"))
    want = sorted(map(repr, rows))
    for size in ("1", "7", "100", "100000"):
        got = read(spark, folder, taskBytes=size).collect()
        assert sorted(repr((r.topic, r.payload, r.ingestion_time)) for r in got) == want
        assert len({r.position for r in got}) == len(rows)
    with open(sorted(p for p in (tmp_path / "log").iterdir() if p.suffix == ".jsonl")[-1], "ab") as f:
        f.write(b'not json\n{"topic": "unfinished')  # the first is a message without a topic, the second isn't there yet
    got = read(spark, folder, taskBytes="64").collect()
    assert len(got) == len(rows) + 1 and any(r.topic is None and r.payload == "not json" for r in got)


def test_a_long_range_of_the_log_is_few_tasks(tmp_path):
    sizes = [700 << 20, 3 << 20, 500 << 20]
    for k, size in enumerate(sizes):
        with open(tmp_path / f"{sum(sizes[:k]):020d}.jsonl", "wb") as f:
            f.truncate(size)
    end = sum(sizes)
    got = Log(str(tmp_path)).ranges(0, end, 200_000)
    assert len(got) <= message_log.TASKS + len(sizes)
    assert got[0].start == 0 and got[-1].end == end and all(a.end == b.start for a, b in zip(got, got[1:]))
    assert max(r.end - r.start for r in Log(str(tmp_path)).ranges(0, end << 10, 1)) <= message_log.TASK_BYTES
    assert len(Log(str(tmp_path)).ranges(0, 1_000_000, 200_000)) == 5  # a short one is cut as asked


def test_ingest_goes_on_from_its_checkpoint_and_gives_each_message_once(spark, tmp_path):
    log, out, checkpoint = (str(tmp_path / x) for x in ("log", "out", "cp"))
    run = lambda: ingest.ingest(message_log.stream(spark, log, taskBytes="300", keepSegments="false"), out, checkpoint).awaitTermination()
    values = [float(k) for k in range(24)]
    land(spark, log, [meter("plug-1", v, int(v)) for v in values[:10]] + [("plug-1/online", "{}", T), ("em-1/status/x", "not json", T)])
    run()
    first = {r.id for r in ingest.measurements(spark, out).collect()}
    assert len(first) == 20 and ingest.table(spark, out, "raw").count() == 11
    store = rollup_job.RollupStore(spark, str(tmp_path / "rollups"))
    rollup_job.initialize(store, ingest.measurements(spark, out), T, None)
    run()  # nothing new
    land(spark, log, [meter("plug-1", v, int(v)) for v in values[10:]])
    # a batch that died left files of its own beside those of the log of the sink
    ingest.table(spark, out, "measurement").drop("kind").limit(5).write.parquet(f"{out}/kind=measurement/dead")
    run()
    rows = ingest.measurements(spark, out)
    ids = [r.id for r in rows.collect()]
    assert len(ids) == len(set(ids)) == 48 and min(set(ids) - first) > max(first)
    assert sorted(r.value for r in rows.where("metric = 'apower'").collect()) == values
    assert [tuple(r)[:4] for r in ingest.registry(spark, out).orderBy("device_id").collect()] == [("shelly", "em-1", None, "em-1"), ("shelly", "plug-1", None, "plug-1")]
    # each measurement's raw row is visible with it, and the history adds the tail past the watermark to the rollup
    assert rows.select("device_id").distinct().join(ingest.table(spark, out, "raw"), "device_id", "left_anti").count() == 0
    params = HistoryParams(metrics=["apower"], start="2026-07-01", end="2026-07-02", aggregate="avg", bucket_unit="hour", bucket_size=1)
    tables = lambda: {n: store.table(n) for n in rollup.STRIDES}
    for size in (6, 100):
        got = history.history(rows, tables(), store.last_id(), "plug-1", params, T).collect()
        assert len(got) == 1 and got[0].value == pytest.approx(sum(values) / len(values))
        rollup_job.run_batch(store, rows, size)
    assert len(Log(log).segments()) < 4  # read segments go


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_registry_follows_the_messages_whatever_the_order_of_batches(spark, tmp_path, order):
    batches = [[uplink("n1", "E1", 0), uplink("n2", None, 0)], [uplink("n1", None, 60), uplink("n2", "E2", 30)]]
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    known = None
    for k in order:
        land(spark, log, batches[k])
        ingest.ingest(message_log.stream(spark, log), out, str(tmp_path / "cp"), "environmental").awaitTermination()
        known = spark.createDataFrame(ingest.registry(spark, out, known).collect(), ingest.REGISTRY)
    want = [("ttn", "n1", None, "n1"), ("ttn", "n2", "E2", "n2")]
    for table in (known, ingest.registry(spark, out)):
        assert [(r.source, r.device_id, r.dev_eui, r.name) for r in table.orderBy("device_id").collect()] == want


def test_rollup_stream_keeps_late_rows_and_restarts(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"d{k % 2}", "t", None if k == 9 else float(k), "C" if k % 3 else None, at(k % 7) if k != 11 else None) for k in range(40)], M)
    halves = [rows.where("id < 20"), rows.where("id >= 20")]
    for half in halves:
        half.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(M).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.rollup_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 300).awaitTermination()
    key = lambda d: sorted((r.device_id, r.bucket_start, r.unit, round(r.value_avg, 9), r.value_min, r.value_max, r.sample_count) for r in d.collect())
    assert key(ingest.rolled(spark, str(tmp_path / "out"))) == key(rollup.build(rows, 300))
    assert len(os.listdir(tmp_path / "out")) >= 6  # a folder a batch, none of them read by another


def test_liveness_without_messages(spark, tmp_path):
    """The clock passes 15 minutes and 24 hours of a silent device with readings of another one."""
    inputs, out = tmp_path / "in", str(tmp_path / "out")
    schema = "device_id string, event_time timestamp_ntz"

    def step(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(inputs))
        liveness.follow(spark.readStream.schema(schema).parquet(str(inputs)), out, str(tmp_path / "cp")).awaitTermination()
        table = spark.read.schema(liveness.CHANGES).parquet(out)
        return {r.device_id: (r.status, r["at"]) for r in liveness.now(table.withColumn("at", F.col("at").cast("timestamp_ntz"))).collect()}, table.count()

    assert step(("quiet", at(0)), ("clock", at(0)), ("clock", at(15)), (None, at(99)), ("quiet", None)) == ({"quiet": ("live", at(0)), "clock": ("live", at(0))}, 2)
    assert step(("clock", at(15, 1)))[0]["quiet"] == ("stale", at(15))
    assert step(*[("clock", at(m)) for m in range(30, 24 * 60 + 1, 15)])[0]["quiet"] == ("stale", at(15))
    got, n = step(("clock", at(24 * 60, 1)))
    assert got == {"quiet": ("offline", at(24 * 60)), "clock": ("live", at(0))} and n == 4
    assert step(("quiet", at(-5)))[1] == 4  # older than its last reading
    got, n = step(("quiet", at(24 * 60 + 1)))
    assert got["quiet"] == ("live", at(24 * 60 + 1)) and n == 5
    got, n = step(("clock", at(90 * 60)))  # the clock itself was silent for two days and more
    assert got == {"quiet": ("offline", at(48 * 60 + 1)), "clock": ("live", at(90 * 60))} and n == 10


def test_a_live_device_shows_its_last_reading(spark, tmp_path):
    """Readings that follow within 15 minutes change nothing, but the last of them is the device's last reading."""
    sf, base = tmp_path / "sf", datetime(2024, 1, 30, 12)
    sf.mkdir()
    rows = [(1, base), (1, base + timedelta(minutes=9)), (2, base - timedelta(minutes=10)), (3, base - timedelta(days=2)), (2, datetime(2024, 1, 12))]
    spark.createDataFrame([(d, t.replace(tzinfo=timezone.utc)) for d, t in rows], "user_id long, ts timestamp").write.parquet(str(sf / "events.parquet"))
    got = catalogue.liveness_now(spark, str(sf))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "live", rows[1][1]), ("2", "stale", rows[2][1]), ("3", "offline", rows[3][1])]
    ok, why = same(got, catalogue.SQL["liveness_now"], str(sf))
    assert ok, why


def test_devices_share_a_state_by_blocks(spark, tmp_path, monkeypatch):
    """Calls of the state store grow with the blocks and not with the devices, which stay apart all the same."""
    monkeypatch.setattr(liveness, "BLOCKS", 2)
    schema, out, cp = "device_id string, event_time timestamp_ntz", str(tmp_path / "out"), str(tmp_path / "cp")
    rows = [(f"d{k}", at(m)) for k in range(60) for m in (0, 5, 20 + k % 3)]  # the gap is 15, 16 or 17 minutes
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    liveness.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, cp).awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "last").load(cp)
    assert state.select("key").distinct().count() == 2
    assert {(r.device_id, r.status, r.last_reading_at) for r in liveness.held(spark, cp).collect()} == {(f"d{k}", "live", at(20 + k % 3)) for k in range(60)}
    want = [(f"d{k}", "live", at(0)) for k in range(60)] + [(f"d{k}", s, t) for k in range(60) if k % 3 for s, t in (("stale", at(20)), ("live", at(20 + k % 3)))]
    got = spark.read.schema(liveness.CHANGES).parquet(out).select("device_id", "status", F.col("at").cast("timestamp_ntz")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def samples(spark, tmp_path, rows):
    path = str(tmp_path / "samples")
    retention.store(spark.createDataFrame(rows, M), path)
    return path


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_late_sample_changes_its_own_window_only(spark, tmp_path):
    rows = [(k, f"d{k % 3}", "t", float(k * k), "Wh", T + timedelta(minutes=11 * k)) for k in range(200)]
    late = (900, "d1", "t", 99_999.0, "Wh", T + timedelta(minutes=11 * 31 + 3))
    path = samples(spark, tmp_path, rows)
    born, now = datetime(2026, 7, 3), datetime(2026, 7, 4)
    old = energy.counter_delta(retention.stored(spark, path)).withColumn("created_at", F.lit(born).cast("timestamp_ntz"))
    fresh = spark.createDataFrame([late, (901, "new", "t", 1.0, "Wh", late[5]), (902, "d1", "t", 1.0, "Wh", None)], M)
    retention.store(fresh, path)
    all_ = retention.stored(spark, path)
    computed = energy.recompute(all_, fresh, energy.counter_delta, day="day")
    assert sorted(r.device_id for r in computed.collect()) == ["d1", "new"]
    plan = computed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [(day" in plan or "day#" in plan.split("PartitionFilters")[1][:200]
    key = lambda d: {tuple(r) for r in d.collect()}
    before, after = key(old), key(energy.refresh_touched(old, all_, fresh, energy.counter_delta, day="day", now=now).select(old.columns))
    changed = after - before
    assert {(r[0], r[-1]) for r in changed} == {("d1", born), ("new", now)} and len(before - after) == 1
    assert {r[:-1] for r in after} == key(energy.counter_delta(all_))
    assert energy.recompute(all_, fresh.limit(0), energy.counter_delta).count() == 0


def test_stored_retention_touches_what_it_must(spark, tmp_path):
    rows = [(k, "d", "t", 1.0, None, T + timedelta(hours=k)) for k in range(100)] + [(500, "d", "t", 1.0, None, None)]
    path = samples(spark, tmp_path, rows)
    before = files(path)
    assert retention.purge(spark, path, T, timedelta(days=1)) == {"dropped": [], "rewritten": []} and files(path) == before
    bound = T + timedelta(hours=40)  # on the third day
    got = retention.purge(spark, path, bound + timedelta(days=1), timedelta(days=1))
    assert got == {"dropped": ["2026-07-01", "2026-07-02"], "rewritten": ["2026-07-03"]} or got["rewritten"] == [str(bound.date())]
    left = sorted(r.id for r in retention.stored(spark, path).collect())
    assert left == [*range(40, 100), 500]
    untouched = {f for f in before if not any(d in f for d in [*got["dropped"], *got["rewritten"]])}
    assert untouched and untouched <= files(path)
    # bounded: the ten oldest ids up to the watermark
    got = retention.purge(spark, path, T + timedelta(days=30), timedelta(days=1), last_id=60, size=10)
    assert sorted(r.id for r in retention.stored(spark, path).collect()) == [*range(50, 100), 500] and not got["dropped"]
    got = retention.purge(spark, path, T + timedelta(days=30), timedelta(days=1), last_id=60, size=1000)
    assert sorted(r.id for r in retention.stored(spark, path).collect()) == [*range(61, 100), 500]
    with pytest.raises(ValueError, match="seed"):
        retention.purge(spark, path, T, timedelta(days=1), size=10)


def test_rounding_by_binary_value(spark):
    rng = random.Random(1)
    xs = [0.0625, 1.0005, 2.0005, -0.0625, 0.0005, 0.0015, 1e-9, 0.0, 1e300, float("inf"), 2.0**43 + 0.0039, 123456789.0005]
    xs += [rng.uniform(-5000, 5000) for _ in range(40_000)] + [rng.randint(-(10**7), 10**7) / 2000 for _ in range(40_000)] + [rng.randint(-(2**50), 2**50) / 2 ** rng.randint(1, 60) for _ in range(30_000)]
    df = spark.createDataFrame(pd.DataFrame({"x": xs}))
    got = df.select("x", *[round_exact(F.col("x"), d).alias(f"d{d}") for d in (0, 3, 6)]).toPandas()
    for d in (0, 3, 6):
        assert [y for x, y in zip(got.x, got[f"d{d}"]) if y != (round(x, d))] == []
    assert round(0.0625, 3) == 0.062 and spark.range(1).select(round_exact(F.lit(None).cast("double"))).first()[0] is None
