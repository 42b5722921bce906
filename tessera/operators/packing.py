"""Budgeted selection: ordered folds in Catalyst, knapsacks per group in Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy(candidates: DataFrame, key: str, order: list[str], id_col: str, full: str, sig: str, budget: Column) -> DataFrame:
    """(key, id, choice, used): in order each candidate whole if it fits, else its signature alone, else nothing more of this pack.

    A choice changes what is left, so this is no running sum; it is a fold over
    each pack's candidates, in one aggregate and an array function. A pack is
    one task's candidate list, small by nature.
    """
    item = F.struct(*order, F.col(id_col).alias("id"), F.col(full).alias("f"), F.col(sig).alias("s"))
    packs = candidates.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"), F.first(budget).cast("double").alias("budget"))
    id_type = dict(candidates.dtypes)[id_col]
    start = F.struct(F.lit(0.0).alias("used"), F.lit(False).alias("stop"), F.array().cast(f"array<struct<id:{id_type},choice:string,used:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        whole = ~s.stop & (s.used + x.f <= F.col("budget"))
        short = ~s.stop & ~whole & (s.used + x.s <= F.col("budget"))
        used = s.used + F.when(whole, x.f).when(short, x.s).otherwise(0.0)
        put = F.struct(x.id.alias("id"), F.when(whole, "full").otherwise("sig").alias("choice"), used.alias("used"))
        return F.struct(used.alias("used"), (s.stop | ~(whole | short)).alias("stop"), F.when(whole | short, F.concat(s.out, F.array(put))).otherwise(s.out).alias("out"))

    folded = packs.select(key, F.aggregate("items", start, step, lambda s: s.out).alias("out"))
    return folded.select(key, F.posexplode("out").alias("pos", "o")).select(key, (F.col("pos") + 1).cast("long").alias("pos"), "o.id", "o.choice", F.round("o.used", 4).alias("used"))


def etag(signature: Column, code: Column) -> Column:
    return F.sha2(F.when(F.coalesce(code, F.lit("")) != "", F.concat_ws("\n", signature, code)).otherwise(signature), 256)


def line_budget(lines: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, kept, cut): the first ``budget`` lines; a cut list says that one more line marks the end."""
    return lines.groupBy(key).agg(F.count_if(F.col("pos") <= budget).alias("kept"), (F.count("*") > budget).alias("cut"))


def call_cap(budget: Column) -> Column:
    """How many calls to list under a token budget."""
    return F.when(budget.isNull(), 12).when(budget < 500, 3).when(budget < 1000, 5).when(budget < 2000, 8).when(budget < 5000, 12).otherwise(20)


#: Largest exact capacity of the knapsack; beyond 5 000 it is scaled.
MOST, SCALED = 10_000, 5_000


def choose(cost: np.ndarray, score: np.ndarray, must: np.ndarray, budget: int) -> np.ndarray:
    """0/1 knapsack over blocks with a positive score, after the must-keep ones are paid for."""
    keep = must.copy()
    left = min(MOST, budget - int(cost[must].sum()))
    free = np.flatnonzero(~must & (score > 0))
    if left <= 0 or not len(free):
        return keep
    scale = 1 if left <= SCALED else -(-left // SCALED)
    cap = left // scale
    w = np.maximum(1, -(-cost[free] // scale)).astype(int)
    best = np.zeros(cap + 1)
    took = np.zeros((len(free), cap + 1), bool)
    for i in range(len(free)):
        if w[i] <= cap:
            other = best[: cap + 1 - w[i]] + score[free[i]]
            better = other > best[w[i] :]
            took[i, w[i] :] = better
            best[w[i] :] = np.where(better, other, best[w[i] :])
    at = cap
    for i in range(len(free) - 1, -1, -1):
        if took[i, at]:
            keep[free[i]] = True
            at -= w[i]
    return keep


def knapsack(blocks: DataFrame, key: str, budget: int, most_blocks: int | None = None) -> DataFrame:
    """(key, block, kept) of (key, block, cost, score, must); ``most_blocks`` then keeps the best by (must, score).

    The blocks of a function become arrays, so that a batch of functions goes
    to Python at once, not one function a call.
    """

    @F.pandas_udf("array<boolean>")
    def pick(costs: pd.Series, scores: pd.Series, musts: pd.Series) -> pd.Series:
        out = []
        for c, s, m in zip(costs, scores, musts, strict=True):
            s, m = np.asarray(s, float), np.asarray(m, bool)
            kept = choose(np.asarray(c, np.int64), s, m, budget)
            if most_blocks is not None and kept.sum() > most_blocks:
                order = sorted(np.flatnonzero(kept), key=lambda i: (not m[i], -s[i], i))
                kept = np.zeros(len(kept), bool)
                kept[order[:most_blocks]] = True
            out.append(kept)
        return pd.Series(out)

    g = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "cost", "score", "must"))).alias("b"))
    g = g.select(key, "b.block", pick("b.cost", "b.score", "b.must").alias("kept"))
    return g.select(key, F.explode(F.arrays_zip("block", "kept")).alias("x")).select(key, "x.block", "x.kept")
