"""Streams of device messages and measurements.

``ingest`` writes everything that a message gives, the raw row and its measurements, as rows of one table by one file sink. The
sink's log makes the rows of a micro-batch visible together and once: a reader sees a message wholly or not at all, and a
batch that died half-way leaves files that no reader looks at. The registry is read off the raw rows, so it can't
disagree with the measurements. Ids are positions in the message log, so a repeated batch gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heliogrid.functions.timebucket import time_bucket
from heliogrid.operators.upsert import merge_registry
from heliogrid.sources.messages import environmental_messages, meter_messages, readings

TABLE = """kind string, id long, source string, device_id string, dev_eui string, name string, topic string, payload string, metric string, value double,
unit string, event_time timestamp_ntz, ingestion_time timestamp_ntz"""
REGISTRY_KEYS = ["source", "device_id"]
REGISTRY = "source string, device_id string, dev_eui string, name string, at timestamp_ntz, id long, name_at timestamp_ntz, name_id long"
ROLLED = "device_id string, metric string, unit string, bucket_start timestamp_ntz, value_sum double, value_min double, value_max double, sample_count long"


def records(messages: DataFrame, kind: str = "meter") -> DataFrame:
    """Rows of TABLE: of each message (position, topic, payload, ingestion_time) one of kind ``raw``, and one of kind ``measurement`` for each reading.

    The raw row's id is the message's position, and those of its readings follow; a line of the log has more bytes than a message has readings.
    """
    parsed = meter_messages(messages, ["position"]) if kind == "meter" else environmental_messages(messages, ["position"])
    null = lambda t: F.lit(None).cast(t)

    def row(what: str, step: Column | int, **given: Column) -> Column:
        columns = {"kind": F.lit(what), "id": F.col("position") + step, "device_id": F.col("device_id"), "source": F.col("source"), "event_time": F.col("event_time")} | given
        return F.struct(*[columns.get(n, null(t)).cast(t).alias(n) for n, t in (f.split() for f in TABLE.split(","))])

    raw = row("raw", 0, dev_eui=F.col("dev_eui"), name=F.col("device_id"), topic=F.col("topic"), payload=F.col("payload"), ingestion_time=F.col("ingestion_time"))
    values = F.transform(readings(F.col("body"), kind), lambda r, k: row("measurement", k + 1, metric=r.metric, value=r.value, unit=r.unit))
    values = F.filter(values, lambda r: r.value.isNotNull())
    return parsed.select(F.explode(F.concat(F.array(raw), values)).alias("r")).select("r.*")


def ingest(stream: DataFrame, folder: str, checkpoint: str, kind: str = "meter") -> StreamingQuery:
    """Append the ``records`` of a message stream to the table in ``folder``, once each."""
    sink = records(stream, kind).writeStream.format("parquet").partitionBy("kind").option("checkpointLocation", checkpoint)
    return sink.outputMode("append").trigger(availableNow=True).start(folder)


def table(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The committed rows of one kind."""
    return spark.read.schema(TABLE).parquet(folder).where(F.col("kind") == kind)


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "measurement").select("id", "device_id", "metric", "value", "unit", "event_time")


def registry_rows(raw: DataFrame) -> DataFrame:
    """What raw rows say of their devices, with the time and the id they say it at."""
    return raw.select("source", "device_id", "dev_eui", "name", F.col("ingestion_time").alias("at"), "id")


def registry(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Devices by source and id, as the table's raw rows leave them; with ``known``, an earlier registry, only later rows are read."""
    rows = registry_rows(table(spark, folder, "raw"))
    if known is None:
        known = spark.createDataFrame([], REGISTRY)
    else:
        last = known.agg(F.max("id")).first()[0]
        rows = rows if last is None else rows.where(F.col("id") > last)
    return merge_registry(known, rows, REGISTRY_KEYS, ["dev_eui"], ["name"], ["at", "id"])


def rollup_stream(stream: DataFrame, folder: str, checkpoint: str, stride: int) -> StreamingQuery:
    """Sums, extremes and counts of each (device, metric, bucket), kept in the state store; each micro-batch appends the buckets that it changed.

    Late rows reach their old bucket however late they are, and nothing that was written is read again. A task adds its own rows up
    before they go to the bucket's state, so a bucket with very many rows isn't a hot one. A repeated batch writes its rows over.
    """
    rows = stream.where("value is not null and event_time is not null")
    sums = rows.groupBy("device_id", "metric", time_bucket(F.col("event_time"), stride).alias("bucket_start")).agg(
        F.max("unit").alias("unit"), F.sum("value").alias("value_sum"), F.min("value").alias("value_min"), F.max("value").alias("value_max"), F.count(F.lit(1)).alias("sample_count")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return sums.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolled(spark: SparkSession, folder: str) -> DataFrame:
    """The rollup as it is: of each bucket the change with most samples, since they only grow."""
    changes = spark.read.schema(ROLLED).parquet(folder)
    values = F.struct("unit", "value_sum", "value_min", "value_max", "sample_count")
    last = changes.groupBy("device_id", "metric", "bucket_start").agg(F.max_by(values, "sample_count").alias("v"))
    return last.select("device_id", "metric", "v.unit", "bucket_start", (F.col("v.value_sum") / F.col("v.sample_count")).alias("value_avg"), "v.value_min", "v.value_max", F.col("v.sample_count").cast("int").alias("sample_count"))
