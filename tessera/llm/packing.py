"""Bulk-synchronous best-fit packing: rounds of range sort, successor sweeps, matches by rank, and updated gaps."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored
from .tokens import ids_of

#: Documents and gaps that one task sweeps; most rounds.
ROWS, MOST_ROUNDS = 200_000, 400
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: What becomes of a row of a sweep: a placed document, a document that is left, a gap that holds any document of later ranges, a smaller gap; and a range's numbers.
PLACED, DOC, GAP, SMALL, NUMBERS = range(5)
_SWEPT = "role int, part int, rank long, id long, size long, sequence_id long, offset long"
ALONE = -(1 << 40)
_MATCHED = "role int, part long, slot long, id long, size long, mine long"


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_for = ids_of(path)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.append(ids_for(text.as_py() or ""), np.uint32(0)).astype("<u4")
                at, no, end = 0, 0, (len(ids) - 1) % capacity + 1
                while at < len(ids):
                    for c, v in zip(cols, (doc, no, at, end - at, zlib.crc32(ids[at:end].tobytes())), strict=True):
                        c.append(v)
                    at, end, no = end, end + capacity, no + 1
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids, with a final id 0; only longer ones than ``capacity`` are cut, the first piece short."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_cut(tokenizer, capacity), _PIECES)


def _sweep(capacity: int):
    """A task's successor sweep over its range of documents and gaps (kind 0: gap), by falling size: each document takes the least gap seen that holds it, and what is left of it is a gap again.

    The first range has the largest gaps of all, so its documents without a gap open sequences. Elsewhere they are left, by rank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[int, list[int]] = {}  # gap -> sequences
        sizes: list[int] = []
        docs, floor = 0, 0
        seen: dict[int, list[int]] = {}  # role -> number, least, largest and sum of the sizes

        def note(role: int, size: int) -> None:
            if role not in seen:
                seen[role] = [1, size, size, size]
                return
            x = seen[role]
            seen[role] = [x[0] + 1, min(x[1], size), max(x[2], size), x[3] + size]

        def push(size: int, seq: int) -> None:
            if size not in held:
                held[size] = []
                insort(sizes, size)
            held[size].append(seq)

        def rows(cols: list[tuple]) -> pa.RecordBatch:
            t = np.array(cols, np.int64).reshape(-1, 7)
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(t[:, i]).cast(k) for i, k in enumerate(kinds)], names=["role", "part", "rank", "id", "size", "sequence_id", "offset"])

        for b in batches:
            out = []
            for size, kind, own in zip(b.column("size").to_pylist(), b.column("kind").to_pylist(), b.column("id").to_pylist(), strict=True):
                floor = size
                if kind == 0:
                    push(size, own)
                    continue
                at = bisect_left(sizes, size)
                if at < len(sizes):
                    gap = sizes[at]
                    seq = held[gap].pop()
                    if not held[gap]:
                        del held[gap]
                        sizes.pop(at)
                elif part == 0:
                    gap, seq = capacity, own
                else:
                    out.append((DOC, part, docs, own, size, -1, -1))
                    note(DOC, size)
                    docs += 1
                    continue
                out.append((PLACED, part, -1, own, size, seq, capacity - gap))
                if gap > size:
                    push(gap - size, seq)
            if out:
                yield rows(out)
        gaps = 0
        for size in sizes:  # the least, which the last documents reach first, has rank 0
            out = []
            role = GAP if size >= floor else SMALL
            for seq in held[size]:
                out.append((role, part, gaps if role == GAP else -1, seq, size, seq, -1))
                note(role, size)
                gaps += role == GAP
            yield rows(out)
        if seen:
            yield rows([(NUMBERS, part, role, *x) for role, x in seen.items()])

    return run


class Match(NamedTuple):
    """Documents ``first`` to ``end`` by rank of range ``docs``, ``each`` to a gap: to the gaps of range ``gaps`` from rank ``at`` on, or to new sequences (gaps = -1)."""

    docs: int
    first: int
    end: int
    each: int
    gaps: int
    at: int


def match_ranges(docs: list[tuple[int, int, int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, largest_small: int) -> list[Match]:
    """The matches between what sweeps have left: docs (range, documents, least, largest, sum of sizes), gaps (range, gaps, least size).

    Ranges fall in size, so a document's successor is a gap of the nearest range
    before its own that has one left; conflicts are settled by rank. A gap takes as many documents as surely
    fit. Documents larger than all gaps open sequences, no more than all that is left would fill: the rest fill what they leave.
    """
    out, stack = [], []
    before = {p: (n, least) for p, n, least in gaps}
    left: list[list[int]] = []
    order = sorted({x[0] for x in docs} | set(before))
    own = {p: x for p, *x in docs}
    for p in order:
        if p in own:
            n, few, most, total = own[p]
            at = 0
            while at < n and stack:
                q, used, have, least = stack[-1]
                each = max(1, least // most)
                take = min(have - used, -(-(n - at) // each))
                end = min(n, at + take * each)
                out.append(Match(p, at, end, each, q, used))
                at = end
                stack[-1][1] += take
                if stack[-1][1] == have:
                    stack.pop()
            if at < n:
                left.append([p, at, n, few, most, -(-total * (n - at) // n)])
        if p in before:
            n, least = before[p]
            stack.append([p, 0, n, least])
    largest_gap = max([largest_small, *[s[3] for s in stack]])
    budget = max(1, -(-sum(x[5] for x in left) // capacity))
    for p, at, n, few, most, _ in left:
        if most <= largest_gap or not budget:
            break
        each = capacity // most
        n = at + max(1, (n - at) * (most - max(largest_gap, few - 1)) // (most - few + 1))  # about as many as are larger
        bins = min(budget, -(-(n - at) // each))
        out.append(Match(p, at, min(n, at + bins * each), each, -1, 0))
        budget -= bins
    return out


def _apply(plan: list[Match]):
    """Rows of a sweep with the range and rank of the gap (or new sequence) that they meet in; those without a match stand alone, under a range below all others."""
    cols = np.array(plan, np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_doc = cols[np.lexsort((cols[:, 1], cols[:, 0]))]
        real = cols[cols[:, 4] >= 0]
        ends = {int(q): int(max(a + -(-(e - f) // n) for _, f, e, n, g, a in real if g == q)) for q in np.unique(real[:, 4])}
        starts = {int(p): np.flatnonzero(by_doc[:, 0] == p) for p in np.unique(by_doc[:, 0])}
        for b in batches:
            role, part, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("role", "part", "rank"))
            meets, mine, slot = ALONE - role, b.column("id").to_numpy().astype(np.int64), np.zeros(len(role), np.int64)
            for p in np.unique(part).tolist():
                gap = np.flatnonzero((part == p) & (role == GAP))
                hit = gap[rank[gap] < ends.get(p, 0)]
                meets[hit], mine[hit] = p, rank[hit]
                doc = np.flatnonzero((part == p) & (role == DOC))
                if p not in starts or not len(doc):
                    continue
                m = by_doc[starts[p]]
                k = np.searchsorted(m[:, 1], rank[doc], side="right") - 1
                ok = (k >= 0) & (rank[doc] < m[k, 2])
                doc, k = doc[ok], k[ok]
                step = rank[doc] - m[k, 1]
                fresh = m[k, 4] < 0
                meets[doc] = np.where(fresh, -10 - p, m[k, 4])
                mine[doc] = np.where(fresh, rank[doc] - step % m[k, 3], m[k, 5] + step // m[k, 3])
                slot[doc] = 1 + step % m[k, 3]
            yield pa.RecordBatch.from_arrays([b.column("role"), pa.array(meets), pa.array(slot), b.column("id"), b.column("size"), pa.array(mine)], names=["role", "part", "slot", "id", "size", "mine"])

    return run


def best_fit(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (length of 1 to ``capacity``, and others) with sequence_id and offset.

    Pieces of the full capacity are sequences by themselves, and those over half of it open one each. All
    others go through rounds, by classes of falling size (no two classes further than a half
    apart), as in best-fit decreasing:

    1. the documents of the class and the gaps that may hold one are range-sorted together by falling size, some 200 000 to a task;
    2. each task sweeps its range: a document takes the least gap that holds it;
    3. what is left is matched across ranges by rank: from a few numbers of each range, the driver
       finds which ranks of documents meet which ranks of gaps in a range before them, or open sequences;
    4. gaps are updated, and rounds are repeated with what is left and the next class, till every document has its place.

    A document moves in the round of its class and, if it found no place, in the next ones. The number of rounds grows
    with the logarithm of the capacity, not with the documents. Where all fit one range, its sweep is
    best-fit decreasing. Only (number, size) of a piece moves. A sequence has the number
    of the piece that opened it. Columns of ``pieces`` named sequence_id or offset give way.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    d = stored(pieces.select(*own, F.monotonically_increasing_id().alias("__pk_id")), "numbered")
    size = F.col("length").cast("long")
    count = {int(n): int(c) for n, c in d.groupBy(size).count().collect()}  # one row of each length
    docs = d.select(size.alias("size"), F.lit(1).alias("kind"), F.col("__pk_id").alias("id"))
    half = capacity // 2
    alone = d.filter(size > half).select(*own, F.col("__pk_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # the gaps of each round, with the bound above which the next one has taken them
    pool = [docs.filter((F.col("size") > half) & (F.col("size") < capacity)).select((capacity - F.col("size")).alias("size"), F.lit(0).alias("kind"), "id")]
    n_gaps = sum(c for n, c in count.items() if half < n < capacity)
    placed, carried, n_carried, largest, bound = [], None, 0, 0, half
    for _ in range(MOST_ROUNDS):
        top = max([largest, *[n for n in count if n <= bound]])
        if not top:
            break
        below = max(capacity // (capacity // top + 1), top * 7 // 10) if 8 * top > capacity else top // 2
        n_docs = n_carried + sum(c for n, c in count.items() if below < n <= bound)
        if n_docs + n_gaps <= ROWS:
            below = 0  # one range holds all that is left: its sweep needs no classes
            n_docs = n_carried + sum(c for n, c in count.items() if n <= bound)
        low = min(below, bound)
        rows = docs.filter((F.col("size") > low) & (F.col("size") <= bound))
        if carried is not None:
            rows = rows.unionByName(carried)
        for k, g in enumerate(pool):
            rows = rows.unionByName(g.filter((F.col("size") > low) & ((F.col("size") <= bound) | F.lit(k + 1 == len(pool)))))
        order = [F.col("size").desc(), F.col("kind"), F.xxhash64("id"), F.col("id")]
        tasks = -(-(n_docs + n_gaps) // ROWS)
        ranges = rows.repartitionByRange(tasks, *order) if tasks > 1 else rows.coalesce(1)
        swept = stored(ranges.sortWithinPartitions(*order).mapInArrow(_sweep(capacity), _SWEPT), "swept")
        placed.append(swept.filter(F.col("role") == PLACED).select("id", "sequence_id", "offset"))
        sums = [tuple(r) for r in swept.filter(F.col("role") == NUMBERS).select("rank", "part", "id", "size", "sequence_id", "offset").collect()]  # three rows of each range at most
        left = [(p, n, few, most, total) for role, p, n, few, most, total in sums if role == DOC]
        small = max((most for role, _, _, _, most, _ in sums if role == SMALL), default=0)
        plan = match_ranges(left, [(p, n, few) for role, p, n, few, _, _ in sums if role == GAP], capacity, small)
        together = W.partitionBy("part", "mine").orderBy("slot")
        head = F.first(F.struct("role", "id", "size")).over(together)
        filled = F.when(head["role"] == DOC, 0).otherwise(capacity - head["size"]) + F.sum(F.when(F.col("role") == DOC, F.col("size")).otherwise(0)).over(together)
        met = swept.filter(F.col("role").isin(DOC, GAP, SMALL)).mapInArrow(_apply(plan), _MATCHED)
        met = met.select("role", "id", "size", (F.col("part") == ALONE - DOC).alias("unmet"), head["id"].alias("sequence_id"), (filled - F.col("size")).alias("offset"), (capacity - filled).alias("left"), F.lead("slot").over(together).isNull().alias("last"))
        met = stored(met, "met")
        placed.append(met.filter((F.col("role") == DOC) & ~F.col("unmet")).select("id", "sequence_id", "offset"))
        pool.append(met.filter("last and not unmet and left > 0").select(F.col("left").alias("size"), F.lit(0).alias("kind"), F.col("sequence_id").alias("id")))
        n_gaps = sum(n for role, _, n, _, _, _ in sums if role in (GAP, SMALL)) + sum(-(-(m.end - m.first) // m.each) for m in plan if m.gaps < 0)
        n_carried = sum(x[1] for x in left) - sum(m.end - m.first for m in plan)
        carried = met.filter("unmet").select("size", F.lit(1).alias("kind"), "id") if n_carried else None
        largest = max((x[3] for x in left), default=0) if n_carried else 0
        bound = low
    else:
        raise RuntimeError(f"best_fit: documents are left after {MOST_ROUNDS} rounds")
    if not placed:
        return alone
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    return alone.unionByName(d.filter(size <= half).join(every, d["__pk_id"] == every["id"]).select(*own, "sequence_id", "offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in as few sequences of ``capacity`` tokens as best fit gets; one row per piece.

    Null text is empty (the id 0 alone). A null id stays null. Repeated rows are packed each; pieces of one
    length are ordered by a hash of their number. Very long texts are cut in pieces, whole. An
    empty table gives an empty result. Only id and text are read, so other columns can't clash.
    Texts are tokenized once; from there on only (id, piece, length, checksum) move.
    """
    return best_fit(cut_pieces(docs, tokenizer, capacity, id_col, text_col), capacity)
