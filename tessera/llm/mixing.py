"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Up to so many sources their rates (about 30 bytes each) are broadcast.
FEW_SOURCES = 100_000
#: A larger mean is drawn as a sum of this much at most, so that exp(-mean) stays exact.
CHUNK = 256.0


def uniform(seed: str, *cols: Column) -> Column:
    """A uniform number in (0, 1) from 52 bits of the MD5 of the seed and the columns; any engine can repeat it."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols])), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The least k with P(X <= k) >= u for X of a Poisson distribution with this mean (at most CHUNK)."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    zero = F.exp(-mean)
    return F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(zero.alias("p"), zero.alias("c"), F.lit(0).alias("k")),
        lambda s, k: F.when(u > s.c, F.struct((s.p * mean / k).alias("p"), (s.c + s.p * mean / k).alias("c"), k.alias("k"))).otherwise(s),
        lambda s: s.k,
    )


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Replicate each document by a Poisson count so that sources reach target weights; then shuffle globally.

    Source s of B_s bytes (UTF-8, plus 1 a row) gets the share w_s of a budget
    of ``budget`` times all bytes: from ``weights`` (sources not named: none),
    else in proportion to B_s ** ``temperature``. Its documents have the mean
    repetition rate w_s * budget * sum(B) / B_s. A document's count is the
    Poisson quantile of that mean at a uniform number hashed from seed and id,
    so it is the same on every run and needs no exchange. Rows with equal id
    have equal counts. Null sources form one source, named ''; null text counts
    1 byte. The result has the columns of ``docs`` (or ``carry``), ``mean_rate``, ``n_copies``,
    ``copy`` (from 1) and ``shuffle_key`` (these win over columns of the same name), and is sorted globally by the key.

    The per-source sums (a row per source) use map-side combine. Up to 100 000
    sources their rates are broadcast, so a hot source is dealt to no one task;
    beyond, the rows meet them by a shuffled join. The one full exchange is the shuffle itself, range-partitioned by a random key: a
    hot source or a document with many copies is dealt evenly.
    """
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1
    sums = docs.select(src.alias("__mx_src"), size.alias("b")).groupBy("__mx_src").agg(F.sum("b").cast("double").alias("b"))
    if weights is None:
        # sums of whole numbers first, then a fixed order: the same mean whatever the partitions
        power = F.round(F.pow("b", F.lit(temperature)), 6)
        goal = sums.agg(F.sum(power.cast("decimal(38,6)")).cast("double").alias("z"), F.sum("b").alias("all"))
        rates = sums.crossJoin(F.broadcast(goal)).select("__mx_src", (power / F.col("z") * F.col("all") * budget / F.col("b")).alias("__mx_mean"))
    else:
        z = float(sum(weights.values())) or 1.0
        spark = docs.sparkSession
        named = spark.createDataFrame([(k, v / z) for k, v in sorted(weights.items())], "__mx_src string, w double")
        goal = sums.agg(F.sum("b").alias("all"))
        rates = sums.join(named, "__mx_src").crossJoin(F.broadcast(goal)).select("__mx_src", (F.col("w") * F.col("all") * budget / F.col("b")).alias("__mx_mean"))
    # written, so that its size is known before the documents move
    rates = stored(rates, "rates")
    rates = F.broadcast(rates) if rates.count() <= FEW_SOURCES else rates
    d = docs.withColumn("__mx_src", src).join(rates, "__mx_src", "inner" if weights is not None else "left")
    parts = F.greatest(F.lit(1), F.ceil(F.col("__mx_mean") / CHUNK)).cast("int")
    d = d.withColumn("__mx_parts", parts)
    mean = F.col("__mx_mean") / F.col("__mx_parts")
    one = poisson_inverse(uniform(seed, F.col(id_col)), mean)
    more = F.aggregate(F.sequence(F.lit(1), "__mx_parts"), F.lit(0), lambda n, i: n + poisson_inverse(uniform(seed, F.col(id_col), i), mean))
    d = d.withColumn("n_copies", F.when(F.col("__mx_parts") == 1, one).otherwise(more).cast("long")).filter("n_copies > 0")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_copies")))
    d = d.withColumn("shuffle_key", uniform(seed + "-order", F.col(id_col), F.col("copy")))
    keep = [c for c in (docs.columns if carry is None else carry) if c not in ("mean_rate", "n_copies", "copy", "shuffle_key")]
    d = d.select(*keep, F.col("__mx_mean").alias("mean_rate"), "n_copies", "copy", "shuffle_key")
    return d.orderBy("shuffle_key")
