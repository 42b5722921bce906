"""Evaluation statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def variant_stats(outcomes: DataFrame, base: Column) -> DataFrame:
    """Per variant: n, success rate, mean, median and sample deviation of tokens, mean ratio to a base without infinite ones."""
    ratio = F.when(F.col("tokens") > 0, base / F.col("tokens"))
    sd = F.when(F.count("*") > 1, F.stddev_samp("tokens")).otherwise(0.0)
    return outcomes.groupBy("variant").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("success").cast("double")), 8).alias("success_rate"), F.round(F.avg("tokens"), 4).alias("mean"),
        F.round(F.median("tokens"), 4).alias("median"), F.round(sd, 4).alias("deviation"), F.round(F.avg(ratio), 6).alias("ratio"),
    )


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where a side has no variance (Spark's own raises there in ANSI mode)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r, p): r is null under three rows or without variance; p about 2 exp(-t^2 / 2)."""
    a = df.agg(F.count("*").alias("n"), correlation(x, y).alias("r0"))
    r = F.when(F.col("n") >= 3, F.col("r0"))
    a = a.withColumn("r", r)
    t2 = F.col("r") * F.col("r") * (F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0))
    return a.select("n", F.round("r", 8).alias("r"), F.round(F.least(F.lit(1.0), 2 * F.exp(-t2 / 2)), 8).alias("p"))


def spearman(df: DataFrame, x: str, y: str, pos: str, per: str | None = None) -> DataFrame:
    """Pearson's r of ordinal ranks, ties in the order of ``pos``; of the whole table or per group."""
    key = [per] if per else []
    rank = lambda c: F.row_number().over(W.partitionBy(*key).orderBy(c, pos)).cast("double")
    r = df.select(*key, rank(x).alias("rx"), rank(y).alias("ry"))
    return r.groupBy(*key).agg(F.count("*").alias("n"), F.round(correlation("rx", "ry"), 8).alias("rho"))


def two_proportions(a: Column, n_a: Column, b: Column, n_b: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """The difference of two rates and its 95 % bounds."""
    p, q = a / n_a, b / n_b
    half = z * F.sqrt(p * (1 - p) / n_a + q * (1 - q) / n_b)
    return F.round(p - q, 8), F.round(p - q - half, 8), F.round(p - q + half, 8)


def bootstrap_median(values: DataFrame, value: str, samples: int = 200, seed: str = "42") -> DataFrame:
    """(n, low, high): the 2.5 and 97.5 % points of the median over resamples.

    Draws come from MD5 of seed, sample and draw, so they are the same on any engine. The
    values (one per pair of an evaluation) carry a rank from 0; resamples are samples x n rows."""
    v = values.select(F.col(value).alias("v"), (F.row_number().over(W.orderBy(value)) - 1).alias("i"))
    n = v.agg(F.count("*").alias("n"))
    draws = values.sparkSession.range(samples).withColumnRenamed("id", "s").crossJoin(F.broadcast(n)).select("s", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("d"))
    draws = draws.withColumn("i", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("s").cast("string"), F.col("d").cast("string"))), 1, 8), 16, 10).cast("long"), F.col("n")).cast("int"))
    medians = draws.join(v, "i").groupBy("s").agg(F.median("v").alias("m"))
    a = medians.agg(F.array_sort(F.collect_list("m")).alias("m"))
    return a.crossJoin(n).select("n", F.round(F.get("m", F.lit(int(0.025 * samples))), 8).alias("low"), F.round(F.get("m", F.lit(min(samples - 1, int(0.975 * samples)))), 8).alias("high"))


def gate(pairs: DataFrame, least_saving: float, most_overhead: float) -> DataFrame:
    """One row: pairs, failures, median savings and latency, and a verdict; without complete pairs it is inconclusive."""
    ok = F.col("state") == "complete"
    saving = F.when(ok & (F.col("baseline") > 0), 1 - F.col("adaptive") / F.col("baseline"))
    a = pairs.agg(F.count_if(ok).alias("pairs"), F.count_if(F.col("state") == "duplicate").alias("failures"), F.median(saving).alias("saving"), F.count_if(saving >= least_saving).alias("wins"), F.count_if(saving < -most_overhead).alias("losses"))
    verdict = F.when(F.col("pairs") == 0, "inconclusive").when(F.col("saving") >= least_saving, "pass").otherwise("fail")
    return a.select("pairs", "failures", F.round("saving", 8).alias("saving"), "wins", "losses", verdict.alias("verdict"))
