"""Delivery logs as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import cut, shared_dir


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; times get a zone, as watermarks need one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return s.withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream comes to once all that is there is read: each batch replaces (complete) or appends a table in the shared folder."""
    out: list[DataFrame] = []

    def sink(batch: DataFrame, _: int) -> None:
        kept = cut(batch, name)
        out[:] = [kept] if mode == "complete" or not out else [out[0].unionByName(kept)]

    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/tessera-stream-{name}-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return out[0] if out else spark.createDataFrame([], stream.schema)


def counters(events: DataFrame) -> DataFrame:
    """Running counts per symbol and type: state is one row per group, in the state store."""
    return events.select(F.get_json_object("props", "$.k").alias("symbol_id"), F.col("event_type").alias("use_type")).groupBy("symbol_id", "use_type").agg(F.count("*").alias("n"))


def daily(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts per day and type under a watermark."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"))
