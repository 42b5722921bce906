"""Tables in the folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local folder serves a local master (one machine: tests, bench); on a cluster it is an error, as executors would each write their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")


_written: dict[str, SparkSession] = {}


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back.

    Later plans start at files, not at a long lineage: if an executor is lost,
    its tasks read them again. The files go when the driver's Python ends, or
    by ``forget``.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete what ``cut`` has written in this process: the files of ``tables``, or all."""
    files = {f for t in tables for f in t.inputFiles()}
    for path, spark in list(_written.items()):
        if tables and not any(path.split("://")[-1] in f for f in files):
            continue
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass
        _written.pop(path, None)


atexit.register(forget)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a table of fewer file splits than cores is dealt anew before work that costs more than the move. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
