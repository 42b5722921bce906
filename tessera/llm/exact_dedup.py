"""Exact dedup by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, bucketed, stored
from .golomb import decode, encode

#: Bits of a fingerprint; its top bits name the owner. A chance hit costs a verification, never a wrong result.
BITS = 48
#: Rows of a block; most bits of a filter of suspects that is broadcast (32 MB).
BLOCK, FILTER_BITS = 1 << 18, 1 << 28
_SENT = "block string, owner int, k int, n int, code binary, shas binary, sizes array<int>, ids array<bigint>"


def _send(owner_bits: int):
    """Per block of rows: the distinct fingerprints of each owner, sorted and coded, with what stays at home (hashes, ids)."""

    def pack(part: int, no: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        ids = t.column("doc_id").to_pylist()
        shas = np.frombuffer(b"".join(t.column("sha").to_pylist()), ">u8").reshape(-1, 4)
        words = shas.astype(np.uint64)
        order = np.lexsort(words.T[::-1])
        s = words[order]
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]).any(axis=1)])
        ends = np.r_[first[1:], len(s)]
        fps = (s[first, 0] >> np.uint64(64 - BITS)).astype(np.int64)
        owner = fps >> (BITS - owner_bits)
        cuts = np.searchsorted(owner, np.arange((1 << owner_bits) + 1))
        out = []
        for o in np.unique(owner).tolist():
            at = np.arange(cuts[o], cuts[o + 1])
            k, code = encode(fps[at] - (o << (BITS - owner_bits)))
            own = order[first[at[0]] : ends[at[-1]]]
            out.append({"block": f"{part}-{no}", "owner": o, "k": k, "n": len(at), "code": code, "shas": shas[order[first[at]]].tobytes(), "sizes": (ends[at] - first[at]).tolist(), "ids": [ids[j] for j in own]})
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["block", "owner", "k", "n", "code", "shas", "sizes", "ids"]
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in out[i : i + 64]], t) for c, t in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= BLOCK:
                yield from pack(part, no, held)
                no, held, rows = no + 1, [], 0
        if held:
            yield from pack(part, no, held)

    return run


def _answer(got: pd.DataFrame) -> pd.DataFrame:
    """An owner's work: which of the fingerprints that it got came more than once; a bitmap for each message."""
    parts = [decode(n, k, c) for n, k, c in zip(got["n"], got["k"], got["code"], strict=True)]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    hit = np.zeros(len(every), bool)
    hit[order] = np.r_[False, same] | np.r_[same, False]
    maps = [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum([len(p) for p in parts])[:-1])]
    return pd.DataFrame({"block": got["block"], "owner": got["owner"], "hits": maps})


def _receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At home: each message with its bitmap -> (sha, ids, suspect) per distinct hash of the block."""
    for b in batches:
        for m in b.to_pylist():
            sizes = np.array(m["sizes"], np.int64)
            hits = np.unpackbits(np.frombuffer(m["hits"], np.uint8))[: m["n"]].astype(bool) | (sizes > 1)
            shas = pa.Array.from_buffers(pa.binary(32), m["n"], [None, pa.py_buffer(m["shas"])]).cast(pa.binary())
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(m["ids"], pa.int64()))
            yield pa.RecordBatch.from_arrays([shas, ids, pa.array(hits)], names=["sha", "ids", "suspect"])


def _picked(texts: DataFrame, suspects: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id a suspect has, and perhaps others."""
    spark = texts.sparkSession
    n = suspects.count()
    bits = 1 << max(10, (8 * n).bit_length())
    if bits > FILTER_BITS:
        own = suspects.select(F.col("doc_id").alias("own")).distinct()
        return texts.join(own, F.col("doc_id").eqNullSafe(F.col("own")), "left_semi")
    hashes = [F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.lit(bits)) for i in (1, 2)]
    marks = suspects.select(F.explode(F.array(*hashes)).alias("bit"))
    marks = marks.groupBy(F.expr("shiftright(bit, 5)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("v"))
    words = np.zeros(bits >> 5, np.uint32)
    found = marks.toPandas()  # at most bits / 32 rows
    words[found["word"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64).astype(np.uint32)
    held = spark.sparkContext.broadcast(words.tobytes())

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series) -> pd.Series:
        w = np.frombuffer(held.value, np.uint32)
        out = np.ones(len(a), bool)
        for x in (a.to_numpy(np.int64), b.to_numpy(np.int64)):
            out &= (w[x >> 5] >> (x & 31).astype(np.uint32)) & 1 == 1
        return pd.Series(out)

    return texts.filter(maybe(*hashes))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is
    replaced by one space; null counts as empty. Of equal texts the row with
    the smallest id stays.

    1. A scan hashes the normalised texts. Each block of a partition sorts its
       distinct fingerprints (48 bits) and sends them, Golomb-coded by owner
       (a range of fingerprints), about 5 bytes each. A text that a third of all
       rows hold is sent once per block. Hashes and ids stay at home, in a
       table of the shared folder that is bucketed by block.
    2. An owner decodes its messages and answers each with a bitmap of the
       fingerprints that came more than once.
    3. The bitmaps go to the blocks, which aren't moved; rows with a hit, or equal to another of
       their block, are suspects. All others are done.
    4. Only suspects are shuffled with their text and grouped by it, byte by
       byte, with map-side combine. Up to 33 million suspects a filter of their
       ids (32 MB at most) picks them in the second scan, and what it lets through beyond
       them is a group of its own and changes nothing; more are picked by
       a shuffled semi-join on the id.

    Owners grow in number with the rows, half a million fingerprints each. A null id
    sorts last: it stays only where the whole group has none. Rows that repeat the
    smallest id are all kept. Very long texts are hashed whole. An empty table gives an
    empty result. Only id and text are read, so other columns can't clash.
    """
    spark = docs.sparkSession
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WS, " ")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("text"))
    rows = base.count()
    owner_bits = min(20, max(6, (rows // 500_000).bit_length()))
    buckets = min(8192, max(8, rows // 500_000))
    sha = F.unhex(F.sha2("text", 256))
    sent = bucketed(base.select("doc_id", sha.alias("sha")).mapInArrow(_send(owner_bits), _SENT), "fingerprints", "block", buckets)
    answers = sent.select("block", "owner", "k", "n", "code").groupBy("owner").applyInPandas(_answer, "block string, owner int, hits binary")
    # one row for each block, of a bit for each of its fingerprints: a join on the block alone finds the buckets in place
    answers = answers.repartition(buckets, "block").groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("owner", "hits"))).alias("answers"))
    home = sent.select("block", "owner", "n", "shas", "sizes", "ids").join(answers, "block").select("n", "shas", "sizes", "ids", F.element_at("answers", F.col("owner")).alias("hits"))
    known = stored(home.mapInArrow(_receive, "sha binary, ids array<bigint>, suspect boolean"), "known")

    suspects = known.filter("suspect")  # a hot text is one row per block, with its ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("text"))
    groups = _picked(texts, suspects.select(F.explode("ids").alias("doc_id"))).groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select(sha.alias("sha"), "keep_id", "group_size")
    met = suspects.join(groups, "sha").select("sha", "ids", "keep_id", "group_size")
    alone = known.filter(~F.col("suspect")).select("sha", "ids", F.get("ids", F.lit(0)).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = met.unionByName(alone).select("sha", F.explode("ids").alias("doc_id"), "keep_id", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
