"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .jaccard import jaccard_links, signature

#: A cell of up to so many members proposes its pairs; a larger one is cut into finer cells.
LIGHT = 32
#: Pivots that discard pairs, beside the 65 whose coordinates make the cells; the widths of the blocks of bits at each level.
N_PIVOTS, WIDTHS = 16, (16, 8, 4, 2)
_PAIRS = list(combinations(range(4), 2))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text: bit b is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return 0
    if len(w) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), 42)]
    else:
        joined = b" ".join(w)
        ends = np.cumsum([len(x) + 1 for x in w]).tolist()
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[starts[i] : ends[i + shingle - 1] - 1], 42) for i in range(len(w) - shingle + 1)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fingerprints(shingle: int, signed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            columns = {"doc_id": b.column("doc_id"), "tie": b.column("tie"), "fp": pa.array(fps, pa.int64())}
            if signed:
                found = [signature(t.as_py()) or (None, None, None) for t in b.column("text")]
                columns |= {c: pa.array([x[i] for x in found], kind) for i, (c, kind) in enumerate({"node": pa.int64(), "size": pa.int32(), "keys": pa.binary()}.items())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pivots(n: int) -> list[int]:
    """Reference fingerprints that discard: the XXH64 of their numbers."""
    return [xxhash.xxh64_intdigest(f"pivot {i}", 42) for i in range(n)]


def _path() -> list[int]:
    """Reference fingerprints that make cells: a first one, and those with its lowest 1, 2, ... 64 bits turned over."""
    first = xxhash.xxh64_intdigest("first pivot", 42)
    return [first ^ ((1 << i) - 1) for i in range(65)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fps`` with ``near``, the Hamming distances to the 65 pivots of the path, and ``far``, those to the 16 that discard."""
    distances = lambda refs: F.array(*[_distance(F.col("fp"), F.lit(_signed(r))).cast("byte") for r in refs])
    return fps.select("*", distances(_path()).alias("near"), distances(_pivots(N_PIVOTS)).alias("far"))


def _free(level: int) -> list[list[int]]:
    """Per way to choose equal blocks at all levels before ``level``, the first bits of the four blocks that may still differ."""
    ways = [[0, 16, 32, 48]]
    for width in WIDTHS[1 : level + 1]:
        ways = [[x for k in range(4) if k not in pair for x in (w[k], w[k] + width)] for w in ways for pair in _PAIRS]
    return ways


def _cells(rows: DataFrame, level: int) -> DataFrame:
    """rows (fp, way, cell) of the pivot table -> six finer cells each: two of the four blocks that may still differ have all their coordinates in common."""
    width = WIDTHS[level]
    rows = pivot_table(rows)
    first = F.get(F.lit(_free(level)), F.col("way"))
    # the coordinate of a bit: the difference of the distances to the pivots before and behind it
    steps = F.zip_with(F.slice("near", 2, 64), F.slice("near", 1, 64), lambda x, y: (x - y).cast("byte"))
    block = lambda k: F.slice("steps", F.get("first", F.lit(k)) + 1, width)
    rows = rows.select("*", steps.alias("steps"), first.alias("first"))
    finer = [F.struct((F.col("way") * 6 + i).alias("way"), F.xxhash64("cell", F.lit(level * 6 + i), block(a), block(b)).alias("cell")) for i, (a, b) in enumerate(_PAIRS)]
    return rows.select("fp", "far", F.explode(F.array(*finer)).alias("x")).select("fp", "far", "x.way", "x.cell")


def candidates(members: DataFrame, radius: int, pivots: bool = True) -> DataFrame:
    """Pairs (u, v) within cells, those discarded whose distances to some pivot differ by more than ``radius``: by the triangle inequality, no true pair goes."""
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, [F.col("a.cell") == F.col("b.cell"), F.col("a.fp") > F.col("b.fp")])
    if pivots:
        apart = F.array_max(F.zip_with("a.far", "b.far", lambda x, y: F.abs(x - y)))
        pairs = pairs.filter(apart <= radius)
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v): all pairs of distinct fingerprints ``fp`` at ``radius`` or fewer bits.

    A table holds each fingerprint's Hamming distances to pivots. The 65 pivots
    of a path differ from the next in one bit, so the differences of
    neighbouring distances are coordinates of one bit each, and those of a block
    of bits tell its cell. Two differing bits leave at least two of four
    blocks alone: a pair within the radius shares all coordinates of two blocks,
    and meets in that cell. In cells of up to 32 members, pairs whose
    distances to any of 16 further pivots differ by more than the radius are
    discarded, and survivors are verified bit by bit: at most 16 pairs a
    member and cell. A larger cell (many near copies) is cut the same way: its
    32 bits that may differ are four blocks of 8, then of 4, then of 2. What is left
    of them is 4 bits, so no cell stays above 16 members, and no pairs
    arise with the square of a group.
    """
    if radius != 2:
        raise ValueError("four blocks are laid out for a radius of 2")
    rows = fps.select("fp", F.lit(0).alias("way"), F.lit(0).cast("long").alias("cell"))
    links = None
    for level in range(len(WIDTHS)):
        cells = _cells(rows, level)
        shared = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
        members = stored(cells.join(shared, "cell"), "cells")
        last = level + 1 == len(WIDTHS)
        found = candidates(members if last else members.filter(F.col("n") <= LIGHT), radius)
        found = found.filter(_distance(F.col("u"), F.col("v")) <= radius)
        links = found if links is None else links.unionByName(found)
        rows = members.filter(F.col("n") > LIGHT).select("fp", "way", "cell")
        if last or rows.isEmpty():
            return links
    return links


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """One row per document: doc_id, fp (the 64 bits as a long), tie, component_id (the least id reachable), root (a fingerprint of the component).

    Texts are lower-cased in A-Z and cut into words at ASCII white space; the
    shingles are ``shingle`` words, repeats included, of the whole text however long; null or blank texts have
    the fingerprint 0 and link like any other. An empty table gives an empty result. Only id and
    text are read, so other columns can't clash. Repeated rows give a row each. Equal fingerprints are one node
    from here on, so exact copies cost nothing. ``tie`` is a hash of the text
    that tells rows with equal ids apart. A null id is larger than any other.
    With ``similarity`` (0.8 or more), texts whose five-word shingle sets have
    at least that Jaccard similarity are linked as well (``jaccard_links``).
    """
    tie = F.xxhash64(F.lit("tie"), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
    texts = rows.select("tie", "text")
    signed = ", node long, size int, keys binary" if similarity is not None else ""
    rows = stored(rows.mapInArrow(_fingerprints(shingle, bool(signed)), "doc_id long, tie long, fp long" + signed), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(nodes.select("fp"), radius)
    if similarity is not None:
        links = jaccard_links(rows.filter("node is not null"), texts, links, similarity)
    roots = components(links)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "tie", "component_id", "root")


def near_dedup(docs: DataFrame, shingle: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """``docs`` with one row left of each group of near copies: the one with the least id.

    Rows that repeat the least id of a group stay together only if their texts are equal
    too; of a group's different texts under one id, the one with the least hash stays. A null id is
    larger than any other. Null and empty texts are one group.
    """
    groups = simhash_groups(docs, shingle, radius, id_col, text_col, similarity)
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("tie").alias("__sh_tie")).drop("root")
    whole = docs.withColumn("__sh_tie", F.xxhash64(F.lit("tie"), F.coalesce(F.col(text_col), F.lit(""))))
    stay = stay.withColumnRenamed("component_id", "__sh_id")
    return whole.join(stay, whole[id_col].cast("long").eqNullSafe(stay["__sh_id"]) & (whole["__sh_tie"] == stay["__sh_tie"]), "left_semi").drop("__sh_tie")
