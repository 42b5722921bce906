"""Sharding by vector bin packing of bytes, tokens and rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WS, key128, stored

#: Groups of at least 1/FINE of a total are placed first; there are 3 * FINE at most.
FINE = 4096
#: Rows that a task packs; most rows of a table that is broadcast.
ROWS, BROADCAST = 250_000, 1_000_000


def place(sizes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The shard of each group. ``sizes`` [n, 3] are its bytes, tokens and rows, ``left`` [shards, 3] the room, in the same units (changed in place).

    Largest share first; each goes to the shard, among those that still have
    room in all three dimensions, where the dot product of its shares with the
    shard's residual capacity is highest. When none has room, to the shard
    with the most bytes left.
    """
    totals = np.maximum(1e-9, left.sum(axis=0))
    need, left_share = sizes / totals, left / totals
    out = np.empty(len(sizes), np.int32)
    for u in np.argsort(-need.max(axis=1), kind="stable").tolist():
        x = need[u]
        room = (left_share >= x).all(axis=1)
        at = int(np.where(room, left_share @ x, -np.inf).argmax()) if room.any() else int(left_share[:, 0].argmax())
        out[u] = at
        left_share[at] -= x
    left[:] = left_share * totals
    return out


def _pack(room: np.ndarray, all_light: np.ndarray):
    """Per task: its groups by ``place`` into the task's share of the room, and the rows' places within (task, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        col = lambda c: t.column(c).to_numpy(zero_copy_only=False)
        fixed = t.column("fixed").fill_null(-1).to_numpy().astype(np.int32)
        light = np.flatnonzero(fixed < 0)
        shard = fixed.copy()
        if len(light):
            keys = np.stack([col("k1")[light], col("k2")[light]], axis=1)
            _, group = np.unique(keys, axis=0, return_inverse=True)
            group = group.ravel()
            three = np.stack([col("size")[light], col("n_tokens")[light], np.ones(len(light))], axis=1).astype(np.float64)
            sizes = np.stack([np.bincount(group, three[:, d]) for d in range(3)], axis=1)
            own = sizes.sum(axis=0) / np.maximum(1, all_light)  # this task's part of all that is packed here
            shard[light] = place(sizes, room * own)[group]
        order = np.lexsort((col("k1"), col("size"), col("text_crc32"), t.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy(), shard))
        s = shard[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        at = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
        t = t.select(["doc_id", "size", "text_crc32", "n_tokens"]).take(pa.array(order))
        part = np.full(len(s), TaskContext.get().partitionId(), np.int32)
        for name, values in (("shard", s), ("part", part), ("at", at.astype(np.int64))):
            t = t.append_column(name, pa.array(values))
        yield from t.to_batches(max_chunksize=65_536)

    return run


def vector_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, n_tokens, shard, slot.

    size is the UTF-8 length plus 1 (null text: 1), tokens are the words.
    Equal texts form a group that stays on one shard. A group over 4/5 of a
    shard's capacity in bytes, tokens or rows is split by id, as one shard
    can't hold it beside its share. Shards end with near equal bytes; tokens
    and rows are balanced along with them.

    Every group is placed by the dot product with residual capacity. Those of at least 1/4096 of a
    total (at most 3 * 4096 of them) and pieces of split ones are placed first, on the
    driver. All others are dealt over tasks by their hash, some 250 000 rows
    each, and every task places its groups, largest first, into its own part of
    the capacity that is left: so the work grows by tasks, and no shard's error
    by more than the smallest groups of each task. Slots are numbered within (task,
    shard), each with its offset.

    Rows equal in all read columns are interchangeable. A null id is ordered
    last. Very long texts are sized whole and, past 4/5 of a shard, can only be one
    row on one shard. An empty table gives an empty result. Only id and text are
    read, so other columns can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = key128(text)
    rows = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.size(F.array_remove(F.split(text, WS, -1), "")).cast("long").alias("n_tokens"),
        ), "shard-rows",
    )
    spark = rows.sparkSession
    sums = [F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("r")]
    total = rows.agg(*sums).first()
    B, T, R = (max(1, total[c] or 0) for c in ("b", "t", "r"))
    share = F.greatest(F.col("b") / B, F.col("t") / T, F.col("r") / R)
    groups = rows.groupBy("k1", "k2").agg(*sums).withColumn("share", share)
    found, pieces = groups.filter(F.col("share") >= 1 / FINE).orderBy("k1", "k2").collect(), []  # at most 3 * FINE rows
    room = np.full((n_shards, 3), 1.0 / n_shards) * np.array([B, T, R], np.float64)
    for g in found:
        n = max(1, -(-int(g["share"] * n_shards * 8 * 1000) // 1000)) if g["share"] > 0.8 / n_shards else 1
        pieces.append(n)
    piece = lambda n: F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), n).cast("int")
    cut = [(g["k1"], g["k2"], n) for g, n in zip(found, pieces, strict=True) if n > 1]
    exact = {}
    if cut:  # what the hash deals to each piece, at most 3 * 10 * n_shards of them
        split = rows.join(F.broadcast(spark.createDataFrame(cut, "k1 long, k2 long, n int")), ["k1", "k2"])
        exact = {tuple(x)[:3]: tuple(x)[3:] for x in split.groupBy("k1", "k2", piece(F.col("n")).alias("piece")).agg(*sums).collect()}
    whole = lambda g: (g["b"], g["t"], g["r"])
    units = [exact.get((g["k1"], g["k2"], i), (0, 0, 0)) if n > 1 else whole(g) for g, n in zip(found, pieces, strict=True) for i in range(n)]
    units = np.array(units, np.float64).reshape(-1, 3)
    at = place(units, room).tolist() if len(units) else []
    ends = np.cumsum(pieces).tolist()
    heavy = spark.createDataFrame([(g["k1"], g["k2"], at[e - n : e]) for g, n, e in zip(found, pieces, ends, strict=True)], "k1 long, k2 long, places array<int>")
    all_light = np.array([B, T, R], np.float64) - units.sum(axis=0)
    d = rows.join(F.broadcast(heavy), ["k1", "k2"], "left").withColumn("fixed", F.get("places", piece(F.size("places")))).drop("places")
    deal = F.when(F.col("fixed").isNull(), F.col("k1")).otherwise(F.xxhash64(F.lit("deal"), "doc_id"))
    d = d.repartition(max(1, -(-R // ROWS)), deal)
    kinds = "doc_id long, size long, text_crc32 long, n_tokens long, shard int, part int, at long"
    d = stored(d.mapInArrow(_pack(np.maximum(room, 0), all_light), kinds), "shards")
    cells = d.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(cells.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST else offsets
    d = d.join(offsets, ["part", "shard"])
    return d.select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("offset") + F.col("at")).alias("slot"))
