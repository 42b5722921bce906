"""Streaming queries: what a drained stream gives is what the batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.standins import DELIVERIES
from tessera.streaming import deliveries as S


@query("inc_01_stream_counters", f"WITH {DELIVERIES} SELECT symbol_id, use_type, count(*) AS n FROM v_deliveries GROUP BY ALL")
def inc_01_stream(spark: SparkSession, sf: str) -> DataFrame:
    return S.drained(S.counters(S.read_events(spark, sf)), "counters")


@query("inc_09_stream_daily", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def inc_09_stream(spark: SparkSession, sf: str) -> DataFrame:
    return S.drained(S.daily(S.read_events(spark, sf)), "daily").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
