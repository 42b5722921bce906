"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). Large: larger neighbours hang on the least of a node and its neighbours. Small: so do the smaller ones and the node."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v of one ordered type, in either direction) -> (node, root), the least node reachable.

    Rounds of large-star and small-star, each written to the shared folder;
    their number grows with the logarithm of the nodes. A hub's records are
    only joined and summed with map-side combine, so AQE may split them.
    Raises if the rounds don't suffice rather than return a partial result.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e, last = stored(e, "links"), None
    for _ in range(most_rounds):
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())
        if state == last or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
        e = stored(_star(_star(e, True).distinct(), False).distinct(), "links")
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")
