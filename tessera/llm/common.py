"""Pieces that the training-data operators share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import cut as stored
from tessera.shared import shared_dir, spread

__all__ = ["LOWER", "UPPER", "WS", "WS_CHARS", "ascii_lower", "bucketed", "key128", "stored", "table", "words"]

#: ASCII white space, the only separators of words here.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``by``: a join on it leaves these rows where they are."""
    spark = df.sparkSession
    table, at = f"tessera_{name}_{uuid.uuid4().hex}", shared_dir(spark).rstrip("/")
    df.write.bucketBy(buckets, by).option("path", f"{at}/{table}").saveAsTable(table)

    def gone() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{table}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass

    atexit.register(gone)
    return spark.table(table)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS, -1), "")


def ascii_lower(s: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def key128(*cols: Column) -> tuple[Column, Column]:
    """Two longs that stand for the values of ``cols``."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)
