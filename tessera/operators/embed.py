"""A deterministic embedder: no model, no network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import code_tokens, normalised


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, size: int = 64) -> DataFrame:
    """(id, embedding): the MD5 of each token names a slot and a sign; signed counts are summed by slot and the vector is normalised.

    Tokens are counted with map-side combine; ids are taken as unique. A text without tokens, or whose signs cancel, has the zero vector.
    """
    at = lambda a, n: F.conv(F.substring(F.md5(F.col("t")), a, n), 16, 10).cast("int")
    tokens = docs.select(id_col, F.explode(code_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("t"))
    sums = tokens.select(id_col, F.pmod(at(1, 4), F.lit(size)).alias("slot"), F.when(at(5, 1) < 8, 1).otherwise(-1).alias("sign")).groupBy(id_col, "slot").agg(F.sum("sign").cast("double").alias("v"))
    held = sums.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"))  # of ``size`` entries at most
    whole = docs.select(id_col).join(held, id_col, "left")
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return whole.select(id_col, raw.alias("raw")).select(id_col, F.when(F.exists("raw", lambda x: x != 0), normalised(F.col("raw"))).otherwise(F.col("raw")).alias("embedding"))
