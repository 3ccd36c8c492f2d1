"""Tables and payloads landed as files, and the requests whose answers they are.

The network calls themselves are driver work outside the engine; a request is a plain dictionary.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from heliogrid.sources import forecast

MEASUREMENTS = "id long, device_id string, metric string, value double, unit string, event_time timestamp_ntz"
ROLLUP = "device_id string, metric string, unit string, bucket_start timestamp_ntz, value_avg double, value_min double, value_max double, sample_count int"
#: Local days and unit of wind speeds of a weather request, and variables of a photovoltaic one.
WEATHER_DAYS = 8
WIND_SPEED_UNIT = "ms"
PV_VARIABLES = [
    "temperature_2m",
    "cloud_cover",
    "shortwave_radiation",
    "direct_normal_irradiance",
    "diffuse_radiation",
    "wind_speed_10m",
]


def horizon(today: date, days: int = WEATHER_DAYS) -> list[date]:
    """The local dates of a forecast, today first."""
    return [today + timedelta(days=k) for k in range(days)]


def weather_request(latitude: float, longitude: float, timezone: str, today: date) -> dict[str, str]:
    dates = horizon(today)
    return {"latitude": str(latitude), "longitude": str(longitude), "hourly": ",".join(forecast.WEATHER), "timezone": timezone, "wind_speed_unit": WIND_SPEED_UNIT, "start_date": dates[0].isoformat(), "end_date": dates[-1].isoformat()}


def pv_request(latitude: float, longitude: float, forecast_days: int = 2, timezone: str = "auto") -> dict[str, str]:
    return {"latitude": str(latitude), "longitude": str(longitude), "hourly": ",".join(PV_VARIABLES), "forecast_days": str(forecast_days), "timezone": timezone}


def day_ahead_request(school_id: str, today: date, target: date | None = None) -> dict[str, str]:
    """By default for tomorrow."""
    return {"school_id": school_id, "target_date": (target or today + timedelta(days=1)).isoformat()}


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """Measurements with their declared types; filters and columns reach the scan."""
    return spark.read.schema(MEASUREMENTS).parquet(path)


def weather_payloads(spark: SparkSession, path: str, request: dict[str, str], fetched_at: datetime) -> DataFrame:
    """Hourly rows of landed weather answers to one request, one JSON document a line."""
    answers = spark.read.schema(forecast.schema(list(forecast.WEATHER))).json(path)
    return forecast.weather_rows(answers, request, fetched_at)


def pv_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Hourly rows of landed photovoltaic weather, under the names of the variables."""
    return forecast.hourly_rows(spark.read.schema(forecast.schema(PV_VARIABLES)).json(path), {v: v for v in PV_VARIABLES})


def day_ahead_answers(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers of day-ahead requests, one JSON document a line: run_id and the answer as text, for ``runs.run_columns``."""
    return spark.read.schema("run_id long, response_json string").json(path)


def health(spark: SparkSession) -> bool:
    return spark.sql("select 1").first()[0] == 1
