"""Day-ahead photovoltaic forecast: features, the day-ahead slice, a pluggable scorer, clip and night mask."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.session import ship_package

#: Fixed value: below this irradiance (W/m2) power is zero.
NIGHT_THRESHOLD = 20.0


def features(rows: DataFrame, lag_1h_kw: float, at: str = "forecast_timestamp") -> DataFrame:
    """Cyclic hour features, and the lag, which is zero at midnight."""
    h = F.hour(at)
    angle = F.lit(2 * math.pi) * h / 24
    return rows.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "lag_1h": F.when(h == 0, 0.0).otherwise(F.lit(float(lag_1h_kw)))})


def second_date(rows: DataFrame, at: str = "forecast_timestamp") -> DataFrame:
    """Rows of the second distinct local date; fewer than two dates are an error."""
    dates = [r[0] for r in rows.select(F.to_date(at).alias("d")).where("d is not null").distinct().orderBy("d").limit(2).collect()]
    if len(dates) < 2:
        raise ValueError("the forecast holds no second date")
    return rows.where(F.to_date(at) == F.lit(dates[1]))


def score(rows: DataFrame, columns: list[str], predict: Callable[[pd.DataFrame], pd.Series], name: str = "raw_kw") -> DataFrame:
    """``rows`` with the model's prediction on ``columns``, in that order, batch by batch."""
    ship_package(rows.sparkSession)

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        return predict(x[columns])

    return rows.withColumn(name, run(F.struct(*columns)))


def clip_and_mask(rows: DataFrame, raw: str, ghi: str, threshold: float = NIGHT_THRESHOLD, mask: bool = True) -> DataFrame:
    """predicted_power_kw: never negative, zero where the irradiance is known and below the threshold."""
    clipped = F.greatest(F.col(raw), F.lit(0.0))
    out = F.when(F.col(ghi) < threshold, 0.0).otherwise(clipped) if mask else clipped
    return rows.withColumn("predicted_power_kw", out)


def diagnostics(rows: DataFrame, raw: str) -> DataFrame:
    """Daily energy and the raw scores' range; whether none is positive."""
    return rows.agg(
        F.sum("predicted_power_kw").alias("daily_energy_kwh"),
        F.min(raw).alias("raw_min"),
        F.max(raw).alias("raw_max"),
        F.avg(raw).alias("raw_mean"),
        F.every(F.col(raw) <= 0).alias("none_positive"),
    )


def hourly_records(rows: DataFrame, run_id: int, columns: list[str], at: str = "forecast_timestamp") -> DataFrame:
    """Rows to append for a run, the model's inputs as JSON."""
    return rows.select(F.lit(run_id).alias("run_id"), F.col(at).alias("forecast_timestamp"), F.to_date(at).alias("forecast_date"), F.hour(at).cast("short").alias("forecast_hour"), "predicted_power_kw", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("raw_features"))


def pv_response(rows: DataFrame) -> DataFrame:
    """(run_id, hours): of each run its hours in order of time, with the power as a number."""
    hour = F.struct(F.col("forecast_timestamp").alias("timestamp"), F.col("forecast_hour").alias("hour"), F.col("predicted_power_kw").cast("double").alias("predicted_power_kw"))
    return rows.groupBy("run_id").agg(F.sort_array(F.collect_list(hour)).alias("hours"))


def report(rows: DataFrame, at: str = "forecast_timestamp") -> Iterator[str]:
    """Console lines, an hour each, then the energy of all of them; one partition at a time comes to the driver."""
    for r in rows.select(at, "predicted_power_kw").orderBy(at).toLocalIterator():
        yield f"{r[0]:%Y-%m-%d %H:%M}  {'-' if r[1] is None else f'{r[1]:.2f} kW'}"
    total = rows.agg(F.coalesce(F.sum("predicted_power_kw"), F.lit(0.0))).first()[0]
    yield f"daily energy {total:.2f} kWh"
