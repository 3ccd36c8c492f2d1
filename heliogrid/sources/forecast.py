"""Hourly forecasts in columnar arrays to rows; range and nearest lookups."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.operators.upsert import last_by_key, replace_by_key

#: Variable of the payload and column of the table.
WEATHER = {
    "temperature_2m": "temperature_2m_c",
    "dew_point_2m": "dew_point_2m_c",
    "relative_humidity_2m": "relative_humidity_2m_percent",
    "surface_pressure": "surface_pressure_hpa",
    "shortwave_radiation": "shortwave_radiation_w_m2",
    "direct_normal_irradiance": "direct_normal_irradiance_w_m2",
    "diffuse_radiation": "diffuse_radiation_w_m2",
    "wind_direction_10m": "wind_direction_10m_degrees",
    "wind_speed_10m": "wind_speed_10m_ms",
    "weather_code": "weather_code",
    "snow_depth": "snow_depth_m",
    "precipitation": "precipitation_mm",
    "cloud_cover": "cloud_cover_percent",
}
#: Fixed value: source of the hourly weather.
WEATHER_SOURCE = "open-meteo"
#: Type of a stored value.
VALUE = "decimal(18,6)"
UPSERT_KEYS = ["source", "latitude", "longitude", "forecast_timestamp"]


def schema(variables: list[str]) -> str:
    """Read schema of a landed payload."""
    arrays = ", ".join(f"{v}: array<double>" for v in variables)
    return f"latitude double, longitude double, timezone string, hourly struct<time: array<string>, {arrays}>"


def array_rows(rows: DataFrame, arrays: dict[str, Column], position: str = "position") -> DataFrame:
    """One row an index of equally long arrays (0-based position); a length that differs fails."""
    sizes = [F.size(a) for a in arrays.values()]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    ok = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("boolean"))
    zipped = F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])
    keep = [c for c in rows.columns if c not in arrays]
    return rows.where(ok).select(*keep, F.posexplode(zipped).alias(position, "_z")).select(*keep, position, *[F.col(f"_z.{n}").alias(n) for n in arrays])


def hourly_rows(payload: DataFrame, variables: dict[str, str] = WEATHER) -> DataFrame:
    """Rows of landed payloads: naive local forecast_timestamp, its date and hour, and the renamed variables.

    A payload without times fails, as does one in which a variable is missing or of another length.
    """
    some = F.when(F.coalesce(F.size("hourly.time"), F.lit(0)) > 0, F.lit(True)).otherwise(F.raise_error(F.lit("the payload holds no times")).cast("boolean"))
    arrays = {"time": F.col("hourly.time")} | {c: F.col(f"hourly.{v}") for v, c in variables.items()}
    rows = array_rows(payload.where(some), arrays).drop("hourly", "position")
    at = F.col("time").cast("timestamp_ntz")
    rows = rows.withColumns({"forecast_timestamp": at, "forecast_date": F.to_date(at), "forecast_hour": F.hour(at)}).drop("time")
    return rows.withColumn("weather_code", F.col("weather_code").cast("int")) if "weather_code" in rows.columns else rows


def weather_rows(payload: DataFrame, request: dict[str, str], fetched_at: datetime, source: str = WEATHER_SOURCE, variables: dict[str, str] = WEATHER) -> DataFrame:
    """``hourly_rows`` with their source, the values as landed and the request that they answer, the latter two as JSON.

    Coordinates and zone are those of the request, as decimals: an answer names the grid cell that it was computed for. Values are decimals
    as they read.
    """
    raw = F.to_json(F.struct(*[F.col(c).alias(v) for v, c in variables.items()]), {"ignoreNullFields": "false"})
    place = {k: F.lit(request[k]).cast("decimal(9,6)") for k in ("latitude", "longitude")}
    rows = hourly_rows(payload, variables).withColumns({"source": F.lit(source), "raw_values": raw, "raw_request": F.lit(json.dumps(request))} | place)
    numbers = {c: F.col(c).cast("string").cast(VALUE) for c in variables.values() if c != "weather_code"}
    now = F.lit(fetched_at).cast("timestamp_ntz")
    return rows.withColumns(numbers | {"timezone": F.lit(request["timezone"])} | {c: now for c in ("fetched_at", "created_at", "updated_at")})


def upsert_weather(current: DataFrame, batch: DataFrame) -> DataFrame:
    """``current`` with the rows of ``batch`` put in place of those of equal UPSERT_KEYS; a row that is replaced keeps its created_at."""
    batch = last_by_key(batch, UPSERT_KEYS, ["fetched_at"])
    born = current.select(*[F.col(k).alias(f"_{k}") for k in UPSERT_KEYS], F.col("created_at").alias("_born"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in UPSERT_KEYS]
    kept = batch.join(born, same, "left").withColumn("created_at", F.coalesce("_born", "created_at")).select(*batch.columns)
    return replace_by_key(current, kept, UPSERT_KEYS)


def in_range(rows: DataFrame, start: datetime, end: datetime, at: str = "forecast_timestamp") -> DataFrame:
    """Rows of the closed range, by time."""
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    return rows.where(F.col(at).between(lit(start), lit(end))).orderBy(at)


def nearest_future(rows: DataFrame, now: datetime, at: str = "forecast_timestamp") -> DataFrame:
    """The first row at or after the current hour."""
    hour = now.replace(minute=0, second=0, microsecond=0)
    return rows.where(F.col(at) >= F.lit(hour).cast("timestamp_ntz")).orderBy(at).limit(1)
