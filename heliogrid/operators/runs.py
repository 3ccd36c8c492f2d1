"""Runs with child rows: latest successful run, lookup of children, day-ahead responses to rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.functions.safe import date_at, decimal_or_null, int_at, kind_of
from heliogrid.operators.upsert import last_by_key

#: Names of the totals and of a room's metrics in a response.
TOTALS = ["facility_kwh", "equipment_kwh", "lighting_kwh", "heating_liters", "cooling_kwh", "fans_hvac_kwh"]
ROOM = ["average_air_temperature_c", "thermal_discomfort_hours", *TOTALS]
ROOMS = ["requested_rooms", "successful_rooms", "failed_rooms"]


def latest_per_group(runs: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The last run of each group by ``order``."""
    return last_by_key(runs, group, order)


def latest_successful(runs: DataFrame, started: str = "started_at", tie: str = "id") -> DataFrame:
    return runs.where("success").orderBy(F.desc_nulls_first(started), F.desc(tie)).limit(1)


def successful_run_id(runs: DataFrame) -> DataFrame:
    return runs.where("success").orderBy(F.desc_nulls_last("completed_at"), F.desc("id")).limit(1).select("id")


def with_children(parents: DataFrame, children: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Parents with their children; a parent without any keeps one row."""
    return parents.join(children, parents[parent_key] == children[key], "left")


def pending(requests: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Requests whose target has no successful run yet."""
    return requests.join(runs.where("success").select(*keys), keys, "left_anti")


def _fields(node: Column, names: list[str]) -> Column:
    """A variant as a struct of its fields ``names``, each a variant; null where it isn't an object."""
    return F.try_variant_get(node, "$", f"struct<{', '.join(f'{n}: variant' for n in names)}>")


def _each(node: str, names: list[str], read: Callable[[Column], Column]) -> Column:
    """Array of what ``read`` makes of the fields ``names`` of a struct: one piece of code however many there are."""
    return F.transform(F.array(*[F.col(f"{node}.{n}") for n in names]), read)


def _text(node: Column) -> Column:
    return F.try_variant_get(node, "$", "string")


def run_columns(rows: DataFrame, response: str = "response_json") -> DataFrame:
    """Run columns of a day-ahead response; sections that aren't objects count as empty.

    Parsed, taken apart and cast in projections of their own: each step is used by many columns of the next. Cast one by one in a single
    projection, the numbers alone make a method that the JVM no longer compiles.
    """
    head = ["status", "simulation_engine", "run_id", "day_ahead_date"]
    out = rows.withColumn("_body", _fields(F.try_parse_json(response), [*head, "summary", "school_totals", "hourly_load"]))
    out = out.withColumns({"_summary": _fields(F.col("_body.summary"), ROOMS), "_totals": _fields(F.col("_body.school_totals"), TOTALS)})
    out = out.withColumns({"_summary": _each("_summary", ROOMS, lambda v: int_at(v, "$")), "_totals": _each("_totals", TOTALS, lambda v: decimal_or_null(_text(v)))})
    load = F.col("_body.hourly_load")
    out = out.withColumns(
        {n: _text(F.col(f"_body.{n}")) for n in ("status", "simulation_engine")}
        | {"external_run_id": _text(F.col("_body.run_id")), "day_ahead_date": date_at(F.col("_body.day_ahead_date"), "$")}
        | {n: F.col("_summary")[k] for k, n in enumerate(ROOMS)}
        | {n: F.col("_totals")[k] for k, n in enumerate(TOTALS)}
        | {"hourly_load": F.to_json(F.when(kind_of(load) == "OBJECT", load))}
    )
    return out.drop("_body", "_summary", "_totals")


def room_results(rows: DataFrame, response: str = "response_json", run: str = "run_id") -> DataFrame:
    """One row a (run, room): the last of equal rooms in the response wins. Only rooms that are left are taken apart, in steps as in ``run_columns``."""
    items = F.try_variant_get(F.try_parse_json(response), "$.room_results", "array<variant>")
    out = rows.select(F.col(run).alias("run_id"), F.posexplode(items).alias("position", "_room"))
    out = last_by_key(out.withColumn("room_id", F.try_variant_get("_room", "$.room_id", "string")), ["run_id", "room_id"], ["position"])
    out = out.withColumn("_room", _fields(F.col("_room"), ["room_label", "status", "error", "metrics"]))
    out = out.withColumn("_metrics", _fields(F.col("_room.metrics"), ROOM))
    text = lambda n: _text(F.col(f"_room.{n}"))
    return out.select("run_id", "room_id", text("room_label").alias("room_label"), text("status").alias("status"), text("error").alias("error_text"), *[decimal_or_null(_text(F.col(f"_metrics.{m}"))).alias(m) for m in ROOM])


def record_rooms(current: DataFrame, answers: DataFrame, response: str = "response_json", run: str = "run_id") -> DataFrame:
    """``current`` room rows with those of the answered runs replaced whole: rooms that an answer no longer names go."""
    asked = answers.select(F.col(run).alias("run_id")).distinct()
    return current.join(asked, "run_id", "left_anti").unionByName(room_results(answers, response, run), allowMissingColumns=True)


#: Columns of a recorded room and the names of its defaults in a response.
RECORDING = ["id", "run_id", "school_id", "recording_date", "room_id", "label", "physical_instance_count", "idf_file", "zone_name", "thermostat_type"]
DEFAULTS = ["occupancy", "heating_setpoint", "cooling_setpoint", "lighting_w_per_m2", "infiltration_ach"]


def recording_response(rows: DataFrame) -> DataFrame:
    """One struct a recorded room: its columns, what it supports, its defaults (numbers but for the occupancy) and the item as recorded."""
    defaults = [F.col(f"default_{d}").cast("double").alias(d) if d != "occupancy" else F.col("default_occupancy").alias(d) for d in DEFAULTS]
    supports = F.struct(F.col("supports_cooling_setpoint").alias("cooling_setpoint"))
    return rows.select(F.struct(*RECORDING, supports.alias("supports"), F.struct(*defaults).alias("defaults"), "raw_item", "created_at", "updated_at").alias("response"))


def room_response(rooms: DataFrame) -> DataFrame:
    """(run_id, rooms): the rooms of each run in order of their ids; metrics only where the room succeeded, error null where there is none."""
    metrics = F.when(F.col("status") == "success", F.struct(*[F.col(m).cast("double").alias(m) for m in ROOM]))
    one = F.struct("room_id", "room_label", "status", metrics.alias("metrics"), F.col("error_text").alias("error"))
    return rooms.groupBy("run_id").agg(F.sort_array(F.collect_list(one)).alias("rooms"))


def day_ahead_response(run: DataFrame, rooms: DataFrame) -> DataFrame:
    """One struct a run: its identity, summary, totals as numbers, hourly load as landed, and its rooms (empty if there are none)."""
    body = F.struct(
        F.col("id"), "school_id", "day_ahead_date", "status", "simulation_engine", "external_run_id",
        F.struct(*ROOMS).alias("summary"),
        F.struct(*[F.col(n).cast("double").alias(n) for n in TOTALS]).alias("school_totals"),
        "hourly_load",
        F.coalesce("rooms", F.expr("filter(array(rooms[0]), x -> false)")).alias("room_results"),
    )
    return run.join(room_response(rooms), run["id"] == F.col("run_id"), "left").select(body.alias("response"))


def create(runs: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """``requests`` with ids that follow the greatest one there is, in order of all their columns."""
    top = runs.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    order = Window.orderBy(*[F.col(c) for c in requests.columns])  # requests are a handful a day
    return requests.withColumn(key, F.lit(top) + F.row_number().over(order))


def finish(runs: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Runs with the columns that ``done`` has put in place; rows it doesn't name stay as they are."""
    new = [c for c in done.columns if c != key]
    both = runs.join(done.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in new]), key, "left")
    return both.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in runs.columns])


def failed(http_status: int | None, error: str) -> dict[str, Column]:
    """Columns of a run that failed."""
    return {"http_status": F.lit(http_status).cast("int"), "success": F.lit(False), "error_text": F.lit(error)}
