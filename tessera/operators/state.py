"""Deliveries, popularity, attention, sessions, retention: state kept as logs and read as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def days_between(now: Column, at: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400.0


def popularity(log: DataFrame, now: Column) -> DataFrame:
    """(symbol_id, deliveries, uses, last_at, score) of a delivery log (symbol_id, at, used).

    The score is 0.6 times the usage rate, 0.3 times 1 / (1 + days since the
    last delivery) and 0.1 times deliveries / 50, at most 1. It is recomputed
    from the log, so a replay changes nothing.
    """
    a = log.groupBy("symbol_id").agg(F.count("*").alias("deliveries"), F.count_if("used").alias("uses"), F.max("at").alias("last_at"))
    return a.withColumn("score", popularity_score(F.col("deliveries"), F.col("uses"), F.col("last_at"), now))


def popularity_score(deliveries: Column, uses: Column, last_at: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0.0), days_between(now, last_at))
    return F.round(0.6 * uses / deliveries + 0.3 / (1 + days) + 0.1 * F.least(deliveries / 50.0, F.lit(1.0)), 8)


def merge_popularity(a: DataFrame, b: DataFrame, now: Column) -> DataFrame:
    """Additive merge of two aggregates."""
    both = a.drop("score").unionByName(b.drop("score")).groupBy("symbol_id").agg(F.sum("deliveries").alias("deliveries"), F.sum("uses").alias("uses"), F.max("last_at").alias("last_at"))
    return both.withColumn("score", popularity_score(F.col("deliveries"), F.col("uses"), F.col("last_at"), now))


def usage(log: DataFrame) -> DataFrame:
    """(symbol_id, n, top_types): uses by type, the three most frequent as type:count."""
    by = log.groupBy("symbol_id", "use_type").agg(F.count("*").alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("use_type")))), 1, 3)
    return by.groupBy("symbol_id").agg(F.sum("n").alias("n"), F.array_join(F.transform(top, lambda x: F.concat_ws(":", x.use_type, (-x.neg).cast("string"))), ",").alias("top_types"))


def co_occurrence(log: DataFrame, batch: str = "session_id") -> DataFrame:
    """(a, b, n): batches in which both symbols are, a < b. Symbols are made distinct per batch first."""
    own = log.select(batch, "symbol_id").distinct()
    a, b = own.select(batch, F.col("symbol_id").alias("a")), own.select(batch, F.col("symbol_id").alias("b"))
    return a.join(b, batch).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def partners(pairs: DataFrame, symbol: str, k: int = 10) -> DataFrame:
    """The symbols most often seen with one."""
    own = pairs.filter((F.col("a") == symbol) | (F.col("b") == symbol))
    return own.select(F.when(F.col("a") == symbol, F.col("b")).otherwise(F.col("a")).alias("partner"), "n").orderBy(F.desc("n"), "partner").limit(k)


def session_summary(log: DataFrame) -> DataFrame:
    """(session_id, total, used, rate)."""
    s = log.groupBy("session_id").agg(F.count("*").alias("total"), F.count_if("used").alias("used"))
    return s.withColumn("rate", F.round(F.col("used") / F.col("total"), 8))


def attention(log: DataFrame, pairs: DataFrame, now: Column, half_life: float = 7.0) -> DataFrame:
    """(symbol_id, score): 0.5 + 0.3 * usage rate + 0.1 while recent + at most 0.1 for partners, blended 0.7 / 0.3 with popularity; 1 at most."""
    p = popularity(log, now)
    ends = pairs.select(F.col("a").alias("symbol_id"), "n").unionByName(pairs.select(F.col("b").alias("symbol_id"), "n")).groupBy("symbol_id").agg(F.sum("n").alias("together"))
    j = p.join(ends, "symbol_id", "left")
    recent = F.when(days_between(now, F.col("last_at")) <= half_life, 0.1).otherwise(0.0)
    own = F.least(F.lit(1.0), 0.5 + 0.3 * F.col("uses") / F.col("deliveries") + recent + F.least(F.lit(0.1), F.coalesce("together", F.lit(0)) / 1000.0))
    return j.select("symbol_id", F.round(0.7 * own + 0.3 * F.col("score"), 9).alias("score"))


def rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """0.7 * relevance + 0.3 * attention (0.5 where there is no history); ties keep their order."""
    j = candidates.join(scores.select("symbol_id", F.col("score").alias("attention")), "symbol_id", "left")
    j = j.withColumn("blend", F.round(0.7 * F.col("relevance") + 0.3 * F.coalesce("attention", F.lit(0.5)), 10))
    return j


def prune(candidates: DataFrame, budget: int, least: float) -> DataFrame:
    """Candidates (symbol_id, score) with ``decision``: kept, below the least score, or over the budget."""
    ok = F.col("score") >= least
    w = W.partitionBy(ok).orderBy(F.desc("score"), "symbol_id")
    r = candidates.withColumn("r", F.row_number().over(w))
    return r.select("symbol_id", "score", F.when(~ok, "below_min").when(F.col("r") > budget, "over_budget").otherwise("kept").alias("decision"))


def hotspots(scored: DataFrame, n: int, since: Column | None = None) -> DataFrame:
    d = scored if since is None else scored.filter(F.col("last_at") >= since)
    return d.orderBy(F.desc("score"), "symbol_id").limit(n)


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by one aggregation (no sort)."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def expired(log: DataFrame, now: Column, ttl_days: float) -> DataFrame:
    """Sessions whose last delivery is older than the time to live."""
    return log.groupBy("session_id").agg(F.max("at").alias("last_at"), F.count("*").alias("n")).filter(days_between(now, F.col("last_at")) > ttl_days)


def evict(objects: DataFrame, cap: float, protect: int, id_col: str = "hash") -> DataFrame:
    """Objects (id, size, last_accessed) to delete, oldest first, until the total is at most ``cap``; the newest ``protect`` stay.

    The running sum goes by one global order: the objects of a store, not the rows of a corpus.
    """
    total = objects.agg(F.sum("size").alias("total"))
    newest = objects.orderBy(F.desc("last_accessed"), F.desc(id_col)).limit(protect).select(id_col)
    free = objects.join(newest, id_col, "left_anti")
    before = F.coalesce(F.sum("size").over(W.orderBy("last_accessed", id_col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return free.withColumn("before", before).crossJoin(F.broadcast(total)).filter(F.col("total") - F.col("before") > cap).select(id_col, "size")


def delta(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(id, state): unchanged, changed or new against the etags delivered before. Both have (id, etag)."""
    old = cached.select("id", F.col("etag").alias("old"))
    return current.join(old, "id", "left").select("id", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("etag"), "unchanged").otherwise("changed").alias("state"))


def index_diff(current: DataFrame, old: DataFrame) -> DataFrame:
    """(id, state): new, changed, unchanged or deleted, by content hash (id, etag)."""
    o = old.select("id", F.col("etag").alias("old"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("etag").isNull(), "deleted").when(F.col("old") == F.col("etag"), "unchanged").otherwise("changed")
    return current.join(o, "id", "full_outer").select("id", state.alias("state"))


def timeline(parts: dict[str, DataFrame], each: int, limit: int) -> DataFrame:
    """Per type the newest ``each`` of (id, at), merged, the newest ``limit`` in all."""
    out = None
    for kind, d in parts.items():
        own = d.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "at").orderBy(F.desc("at"), F.desc("id")).limit(each)
        out = own if out is None else out.unionByName(own)
    return out.orderBy(F.desc("at"), "kind", "id").limit(limit)
