"""Near copies by the Jaccard similarity of their five-word shingles: banded MinHash keys propose pairs, prefixes of ordered sets cut large buckets, the whole shingle sets verify."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

WORDS, LEAST = 5, 0.8
#: A pair at a similarity of 0.8 shares none of the 24 keys with a probability of (1 - 0.8^4)^24 = 3e-6; above it with less.
BANDS, ROWS = 24, 4
#: Buckets up to this size propose all their pairs at once; texts wanted for verifying are found by broadcast up to so many.
LIGHT, BROADCAST = 32, 1_000_000
#: A shingle that one in so many texts of a cluster has is frequent there, and so comes last in its sets; a cluster has at most so many times its mean size of them.
FREQUENT = 8
#: Two to this power is the number of bits of a set's parities.
PARITIES = 9
_RNG = np.random.default_rng(42)
_MUL = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def grams(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's distinct five-word shingles, sorted, mixed from the XXH64 of each word; words as in the fingerprint, a shorter text is one shingle."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, 42) for x in w], np.uint64)
    n = min(WORDS, len(h))
    g = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        g = (g ^ (g >> np.uint64(31))) * _MUL[i] + h[i : len(h) - n + 1 + i]
    return np.unique((g ^ (g >> np.uint64(29))) * _MUL[WORDS])


def keys(g: np.ndarray) -> bytes:
    """One key for each band of four least values, as little-endian longs."""
    least = np.full((BANDS * ROWS, 1), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(g), 4096):
        least = np.minimum(least, (_MUL * g[at : at + 4096] + _ADD).min(axis=1, keepdims=True))
    x = (least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * _MIX
    return x.sum(axis=1, dtype=np.uint64).tobytes()


def signature(text: str | None) -> tuple[int, int, bytes] | None:
    """(node: a hash of the shingle set, its size, its keys); none for a text without words."""
    g = grams(text)
    return (int(np.uint64(xxhash.xxh64_intdigest(g.tobytes(), 42)).view(np.int64)), len(g), keys(g)) if len(g) else None


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([grams(t.as_py()).tobytes() for t in b.column("text")], pa.binary())], names=["node", "grams"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flat = np.frombuffer(b"".join(k.as_py() for k in b.column("keys")), np.int64)
        again = np.repeat(np.arange(b.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(flat), b.column("node").take(pa.array(again))], names=["key", "node"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each shingle is in a batch's sets of one cluster."""
    for b in batches:
        at, sets = b.column("cluster").to_numpy(), [np.frombuffer(x.as_py(), np.int64) for x in b.column("grams")]
        for c in np.unique(at):
            gram, n = np.unique(np.concatenate([sets[i] for i in np.flatnonzero(at == c)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), c)), pa.array(gram), pa.array(n.astype(np.int64))], names=["cluster", "gram", "n"])


def prefix(g: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The beginning of a set, in the order of its cluster (frequent shingles last, in the order given), that shares a shingle with the beginning of any similar set."""
    often = np.isin(g, frequent, assume_unique=True)
    return np.concatenate([g[~often], frequent[np.isin(frequent, g, assume_unique=True)]])[: len(g) - math.ceil(similarity * len(g) - 1e-9) + 1]


def parities(g: np.ndarray) -> bytes:
    """Whether a set has an odd number of the shingles that fall to each of 512 bits. Two sets differ in at least as many shingles as these bits differ."""
    return np.packbits(np.bincount((g.view(np.uint64) >> np.uint64(64 - PARITIES)).astype(np.int64), minlength=1 << PARITIES) % 2 == 1).tobytes()


def _prefixes(similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            often = [np.array(x.as_py() or [], np.int64) for x in b.column("frequent")]
            found = [prefix(np.frombuffer(g.as_py(), np.int64), x, similarity) for g, x in zip(b.column("grams"), often, strict=True)]
            if not found:
                continue
            flat = np.frombuffer(b"".join(parities(np.frombuffer(g.as_py(), np.int64)) for g in b.column("grams")), np.int64)
            odd = pa.FixedSizeListArray.from_arrays(pa.array(flat), 1 << PARITIES - 6).cast(pa.list_(pa.int64()))
            again = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found]))
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
            carried = [b.column(c).take(again) for c in ("cluster", "node", "fp", "size", "root")]
            named = ["cluster", "node", "fp", "size", "root", "gram", "place", "odd"]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(np.concatenate(found)), pa.array(place), odd.take(again)], names=named)

    return run


def _verified(similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("g"), b.column("h"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both + 1e-9 >= similarity * (len(x) + len(y) - both))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column("u").take(at), b.column("v").take(at)], names=["u", "v"])

    return run


def _sets(nodes: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, grams) of ``nodes``, each from one of its texts. ``texts`` has (tie, text)."""
    wanted = stored(rows.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("tie").alias("tie")), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    sets = texts.join(side, "tie").select("node", "text").mapInArrow(_texts, "node long, grams binary").dropDuplicates(["node"])
    return stored(sets, "sets")


def _verify(pairs: DataFrame, rows: DataFrame, texts: DataFrame, similarity: float, sets: DataFrame | None = None) -> DataFrame:
    """Links (u, v) between fingerprints of those pairs (a, b, u, v; a and b are nodes) whose shingle sets are similar enough. ``sets`` has theirs, if they are read already."""
    pairs = stored(pairs.filter("u <> v").distinct(), "pairs")
    if sets is None:
        sets = _sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), rows, texts)
    g, h = sets.select(F.col("node").alias("a"), F.col("grams").alias("g")), sets.select(F.col("node").alias("b"), F.col("grams").alias("h"))
    found = pairs.join(g, "a").join(h, "b").select("u", "v", "g", "h").mapInArrow(_verified(similarity), "u long, v long")
    return stored(found.distinct(), "similar")


def _across(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, u, v) of different roots within clusters that may be similar, none of the similar ones left out.

    ``members`` has (node, fp, size, root, cluster), ``sets`` (node, grams). The sets of a cluster are ordered
    alike, with shingles that many of them have at the end. Similar sets share a shingle in the first
    fifth of both; from the places of the first they share follows how many more they can have in common, and parities bound how many they differ in. A text that
    has more of its own than similar texts may have thus meets no other, however many copies of the rest there are.
    """
    own = stored(members.join(sets, "node"), "ordered")
    sizes = own.groupBy("cluster").agg(F.count("*").alias("of"))
    counts = own.select("cluster", "grams").mapInArrow(_counted, "cluster long, gram long, n long").groupBy("cluster", "gram").agg(F.sum("n").alias("n"))
    often = counts.filter("n > 1").join(sizes, "cluster").filter(F.col("n") * FREQUENT >= F.col("of")).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("x")).select("cluster", F.col("x.gram").alias("frequent"))
    begun = own.join(often, "cluster", "left").mapInArrow(_prefixes(similarity), "cluster long, node long, fp long, size int, root long, gram long, place int, odd array<bigint>")
    begun = stored(begun, "prefixes")
    # of a shingle's commonest root only meetings with others matter
    roots = begun.groupBy("cluster", "gram", "root").agg(F.count("*").alias("n"))
    mixed = roots.groupBy("cluster", "gram").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    met = stored(begun.join(mixed, ["cluster", "gram"]), "met")
    p, q = met.filter("root <> major").alias("p"), met.alias("q")
    both = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("p.size") + F.col("q.size")) - 1e-9)
    room = F.least(F.col("p.size") - F.col("p.place"), F.col("q.size") - F.col("q.place"))
    once = (F.col("q.root") == F.col("q.major")) | (F.col("p.node") > F.col("q.node"))
    differ = F.aggregate(F.zip_with("p.odd", "q.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    on = [F.col("p.cluster") == F.col("q.cluster"), F.col("p.gram") == F.col("q.gram"), F.col("p.root") != F.col("q.root"), once, room >= both, differ <= F.col("p.size") + F.col("q.size") - 2 * both]
    return p.join(q, on).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.fp").alias("u"), F.col("q.fp").alias("v"))


def jaccard_links(rows: DataFrame, texts: DataFrame, known: DataFrame, similarity: float = LEAST) -> DataFrame:
    """``known`` links between fingerprints and more of them, so that texts whose five-word shingle sets have a Jaccard similarity of ``similarity`` or more are connected.

    ``rows`` has (tie, fp, node, size, keys) of each text with words. Equal sets
    are one node. Buckets of up to 32 nodes with one key propose all pairs. In a
    larger one, all members are first compared with its least; then, if that
    leaves members of one bucket in different components, its texts' ordered sets are compared by their
    beginnings (``_across``). So each pair with a common key is compared, ruled out by
    its sets' beginnings, or connected already; neither a large group of copies nor one of texts
    that are nearly, not quite, similar makes pairs with the square of its size. Similarities are of the whole sets.
    """
    if not LEAST <= similarity <= 1:
        raise ValueError(f"keys are laid out for a similarity of {LEAST} or more")
    nodes = stored(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")), "nodes")
    same = rows.select("node", F.col("fp").alias("u")).distinct().join(nodes.select("node", F.col("fp").alias("v")), "node").filter("u <> v").select("u", "v")
    keyed = nodes.select("node", "keys").mapInArrow(_unpacked, "key long, node long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    own = nodes.select("node", "fp", "size")
    first = own.select(F.col("node").alias("at"), F.struct("node", "fp", "size").alias("least"))
    shared = stored(shared.withColumnRenamed("least", "at").join(first, "at").drop("at"), "shared-keys")
    # only what is in a bucket with others meets its fingerprint and size
    members = keyed.join(shared, "key").join(own, "node").select("key", "node", "fp", "size", "n", "least")
    members = stored(members, "members")
    light, heavy = members.filter(F.col("n") <= LIGHT), members.filter(F.col("n") > LIGHT)
    alike = lambda x, y: F.least(x, y) >= F.greatest(x, y) * similarity - 1e-9
    named = lambda a, b: [F.col(f"{a}.node").alias("a"), F.col(f"{b}.node").alias("b"), F.col(f"{a}.fp").alias("u"), F.col(f"{b}.fp").alias("v")]
    both = lambda d, *more: d.alias("p").join(d.alias("q"), [F.col("p.key") == F.col("q.key"), alike(F.col("p.size"), F.col("q.size")), *more])
    pairs = both(light, F.col("p.node") > F.col("q.node")).select(*named("p", "q"))
    star = heavy.alias("p").filter(F.col("p.node") > F.col("p.least.node")).filter(alike(F.col("p.size"), F.col("p.least.size"))).select(*named("p", "p.least"))
    links = stored(known.unionByName(same).unionByName(_verify(pairs.unionByName(star), rows, texts, similarity)), "known")
    if heavy.isEmpty():
        return links
    roots = components(links)
    rooted = heavy.select("key", "node", "fp", "size", F.col("least.node").alias("least")).join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "rooted_members")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    inside = stored(rooted.join(mixed, "key", "left_semi"), "inside")
    if inside.isEmpty():
        return links
    clusters = components(inside.select(F.col("node").alias("u"), F.col("least").alias("v"))).withColumnRenamed("root", "cluster")
    inside = inside.select("node", "fp", "size", "root").distinct().join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    inside = stored(inside, "clustered")
    sets = _sets(inside, rows, texts)
    return links.unionByName(_verify(_across(inside, sets, similarity), rows, texts, similarity, sets))
