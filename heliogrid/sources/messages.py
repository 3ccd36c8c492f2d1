"""Device messages (topic, payload, ingestion_time) to raw rows and long measurements.

Parsing is a projection of built-in functions over VARIANT values, the same for batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.functions.safe import kind_of, loose_number_at, number_at

#: Metric, place in the payload and unit of each reading.
ENVIRONMENTAL = [
    ("temperature", "$.uplink_message.decoded_payload.environmental.temperature", "C"),
    ("relative_humidity", "$.uplink_message.decoded_payload.environmental.relative_humidity", "%"),
    ("co2", "$.uplink_message.decoded_payload.co2.co2", "ppm"),
    ("voc", "$.uplink_message.decoded_payload.voc_index.voc", None),
    ("pm1", "$.uplink_message.decoded_payload.pm_MC.pm1", "ug/m3"),
    ("pm25", "$.uplink_message.decoded_payload.pm_MC.pm25", "ug/m3"),
    ("pm4", "$.uplink_message.decoded_payload.pm_MC.pm4", "ug/m3"),
    ("pm10", "$.uplink_message.decoded_payload.pm_MC.pm10", "ug/m3"),
]
METER = [
    ("apower", "$.apower", "W"),
    ("aenergy_total", "$.aenergy.total", "Wh"),
    ("ret_aenergy_total", "$.ret_aenergy.total", "Wh"),
    ("total_current", "$.total_current", "A"),
    ("a_act_power", "$.a_act_power", "W"),
    ("b_act_power", "$.b_act_power", "W"),
    ("c_act_power", "$.c_act_power", "W"),
    ("total_act_power", "$.total_act_power", "W"),
    ("a_aprt_power", "$.a_aprt_power", "VA"),
    ("b_aprt_power", "$.b_aprt_power", "VA"),
    ("c_aprt_power", "$.c_aprt_power", "VA"),
    ("total_aprt_power", "$.total_aprt_power", "VA"),
]


#: Source of devices that report by uplink, and of meters.
UPLINK = "ttn"
METERS = "shelly"


def _naive_utc(seconds: Column) -> Column:
    return F.timestamp_add("MICROSECOND", (seconds * 1_000_000).cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def meter_messages(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Status messages of meters with source, device_id, event_time, payload text, its variant ``body`` and the columns ``keep``.

    Topics other than <device>/status/... and empty devices go. Text that isn't JSON is wrapped as
    {"raw_payload": text}. The time is the first numeric minute_ts of the two counters, else the ingestion time.
    """
    parts = F.split("topic", "/")
    rows = rows.where((F.size(parts) >= 2) & (F.get(parts, F.lit(1)) == "status") & (F.get(parts, F.lit(0)) != ""))
    rows = rows.withColumn("body", F.try_parse_json("payload"))
    text = F.when(F.col("body").isNull(), F.to_json(F.struct(F.col("payload").alias("raw_payload")))).otherwise(F.col("payload"))
    at = F.coalesce(*[_naive_utc(number_at(F.col("body"), f"$.{s}.minute_ts")) for s in ("aenergy", "ret_aenergy")], F.col("ingestion_time"))
    eui = F.lit(None).cast("string").alias("dev_eui")
    return rows.select(*(keep or []), F.lit(METERS).alias("source"), F.get(parts, F.lit(0)).alias("device_id"), eui, "topic", text.alias("payload"), at.alias("event_time"), "ingestion_time", "body")


def environmental_messages(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Uplink messages with source, device_id, dev_eui, event_time and the columns ``keep``; text that isn't JSON fails, no device id goes."""
    body = F.parse_json("payload")
    rows = rows.withColumn("body", body)
    get = lambda p: F.try_variant_get("body", p, "string")
    at = F.to_timestamp_ntz(F.regexp_replace(get("$.received_at"), r"(\.\d{6})\d*|Z$|[+-]\d\d:\d\d$", "$1"))
    out = rows.select(*(keep or []), F.lit(UPLINK).alias("source"), get("$.end_device_ids.device_id").alias("device_id"), get("$.end_device_ids.dev_eui").alias("dev_eui"), "topic", "payload", at.alias("event_time"), "ingestion_time", "body")
    return out.where("device_id is not null and device_id <> ''")


def readings(body: Column, kind: str) -> Column:
    """Array of struct(metric, value, unit) of a message's body, in order of the kind's table; a reading that isn't there has a null value.

    Readings of meters are numbers, strings and booleans don't count; the others are numbers or read as one. Both meter kinds are
    tried on every message.
    """
    meter = kind == "meter"
    number = number_at if meter else loose_number_at
    one = [F.struct(F.lit(m).alias("metric"), number(body, path).alias("value"), F.lit(u).cast("string").alias("unit")) for m, path, u in (METER if meter else ENVIRONMENTAL)]
    there = kind_of(body) == "OBJECT" if meter else F.lit(True)
    none = F.array().cast("array<struct<metric:string,value:double,unit:string>>")
    return F.when(F.coalesce(there, F.lit(False)), F.array(*one)).otherwise(none)


def _long(messages: DataFrame, kind: str) -> DataFrame:
    rows = messages.select("device_id", "event_time", F.explode(readings(F.col("body"), kind)).alias("r"))
    return rows.select("device_id", "r.metric", "r.value", "r.unit", "event_time").where("value is not null")


def meter_measurements(messages: DataFrame) -> DataFrame:
    return _long(messages, "meter")


def environmental_measurements(messages: DataFrame) -> DataFrame:
    return _long(messages, "environmental")


def unpivot(rows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Wide to long: (ids, metric, value) of the values that aren't null."""
    return rows.unpivot(ids, columns, "metric", "value").where("value is not null")
