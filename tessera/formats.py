"""Output forms: compact, packed and columnar JSON, texts with a path dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def compact(found: DataFrame) -> DataFrame:
    """(file, compact): the symbols of each file as JSON, only name, signature, line and the first line of a docstring."""
    s = found.filter("fact = 'symbol'")
    doc = F.nullif(F.trim(F.get(F.split("text", "\n"), F.lit(0))), F.lit(""))
    item = F.struct(F.col("function").alias("name"), "signature", F.col("a").alias("line"), doc.alias("doc"))
    g = s.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("a", item.alias("i")))).alias("x"))
    return g.select("file", F.to_json("x.i").alias("compact"))


def packed_json(names: dict[str, str]) -> Column:
    """A row as JSON under short keys; null fields are left out."""
    return F.to_json(F.struct(*[F.col(k).alias(v) for k, v in names.items()]))


def columnar(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """One row per key, an array per column; nulls keep their place."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *columns))).alias("x"))
    return g.select(key, *[F.col(f"x.{c}").alias(c) for c in columns])


def from_columnar(packed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return packed.select(key, F.explode(F.arrays_zip(*columns)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def ultracompact(rows: DataFrame) -> DataFrame:
    """(file, text) of (file, ord, line): each file's lines under its number in the path dictionary. Files are numbered over their distinct names only."""
    g = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x.line), "\n").alias("body"))
    n = F.row_number().over(W.orderBy("file")) - 1
    ids = rows.select("file").distinct().withColumn("p", n)
    return g.join(ids, "file").select("file", F.concat(F.lit("P"), F.col("p").cast("string"), F.lit("="), F.col("file"), F.lit("\n"), F.col("body")).alias("text"))


def truncated(text: str, most_lines: int | None = None, most_bytes: int | None = None) -> str:
    """A rendered text cut by lines and bytes, back to the last blank line, with a note."""
    lines = text.split("\n")
    keep = lines[:most_lines] if most_lines is not None else lines
    while most_bytes is not None and keep and len("\n".join(keep).encode()) > most_bytes:
        keep = keep[:-1]
    if len(keep) == len(lines):
        return text
    blank = max((i for i, x in enumerate(keep) if not x.strip()), default=None)
    keep = keep[:blank] if blank else keep
    return "\n".join([*keep, f"... [{len(lines) - len(keep)} lines cut]"])
