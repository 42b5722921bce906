"""Unified diffs to hunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hunks(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "text") -> DataFrame:
    """(id, file, start_line, end_line): the new side of each hunk; the file is carried forward from its header, deletions have no lines."""
    d = diffs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    name = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.*)$", 1)
    w = W.partitionBy(id_col).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("file", F.last(F.when(F.col("line").startswith("+++ "), name), ignorenulls=True).over(w))
    at = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    d = d.filter(F.rlike("line", F.lit(at)) & F.col("file").isNotNull() & (F.col("file") != "/dev/null"))
    start = F.regexp_extract("line", at, 1).cast("int")
    size = F.regexp_extract("line", at, 2)
    n = F.when(size == "", 1).otherwise(F.try_to_number(size, F.lit("999999999")).cast("int"))
    return d.select(id_col, "file", start.alias("start_line"), (start + n - 1).alias("end_line")).filter("end_line >= start_line")
