"""Operators on small fixtures, where the driver's tables can't show the case."""

from __future__ import annotations

import itertools
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import formats
from tessera.operators import graph, packing, relational, search, state, statistics
from tessera.sources import files as W


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_greedy_fold_stops_at_the_first_that_fits_in_no_form(spark):
    d = spark.createDataFrame([("p", i, f, s) for i, (s, f) in enumerate([(10.0, 50.0), (10.0, 60.0), (10.0, 20.0), (90.0, 95.0), (1.0, 2.0)])], "pack string, ord long, full double, sig double")
    got = packing.greedy(d.withColumn("sid", F.col("ord")), "pack", ["ord"], "sid", "full", "sig", F.lit(100))
    assert [(r["id"], r["choice"], r["used"]) for r in got.orderBy("pos").collect()] == [(0, "full", 50.0), (1, "sig", 60.0), (2, "full", 80.0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 9), st.booleans()), min_size=1, max_size=8), st.integers(0, 30))
def test_knapsack_is_optimal(blocks, budget):
    cost, score, must = (np.array(x) for x in zip(*blocks, strict=True))
    got = packing.choose(cost, score.astype(float), must.astype(bool), budget)
    assert all(got[must])
    left = budget - cost[must].sum()
    free = [i for i in range(len(cost)) if not must[i]]
    best = max((sum(score[i] for i in c) for n in range(len(free) + 1) for c in itertools.combinations(free, n) if sum(cost[i] for i in c) <= max(left, 0)), default=0)
    assert score[got & ~must].sum() == (best if left > 0 else 0)


def test_block_scores_favour_neighbours(spark):
    b = spark.createDataFrame([(1, i, i, False) for i in range(3)], "doc_id long, block long, pos long, control boolean")
    hit = spark.createDataFrame([(1, 1)], "doc_id long, pos long")
    assert rows(relational.score_blocks(b, hit)) == [(1, 0, 3.0), (1, 1, 10.0), (1, 2, 3.0)]


def test_popularity_fixture(spark):
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    d = spark.createDataFrame([("s1", "a", True), ("s1", "b", False), ("s2", "a", False), ("s2", "c", True)], "session_id string, symbol_id string, used boolean").withColumn("at", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert rows(state.popularity(d, now).select("symbol_id", "deliveries", "uses")) == [("a", 2, 1), ("b", 1, 0), ("c", 1, 1)]


def test_index_diff_sees_deletions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (4, "n")], "id long, etag string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "id long, etag string")
    assert rows(state.index_diff(a, b)) == [(1, "unchanged"), (2, "changed"), (3, "deleted"), (4, "new")]


def test_merged_windows_and_ranges(spark):
    w = spark.createDataFrame([("f", 1, 4), ("f", 5, 6), ("f", 9, 10), ("f", 2, 3)], "k string, start long, end long")
    assert rows(relational.merge_windows(w, "k")) == [("f", 1, 6), ("f", 9, 10)]
    p = spark.createDataFrame([("f", x) for x in (1, 2, 4, 4, 5, 9)], "k string, pos long")
    assert rows(relational.ranges(p, "k", "pos")) == [("f", 1, 2), ("f", 4, 5), ("f", 9, 9)]


def test_pearson_without_variance_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert statistics.pearson(d, "x", "y").first()["r"] is None


def test_bm25_of_an_unknown_term_is_empty(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    assert search.bm25(d, ["nothing"]).count() == 0


def test_candidates_merge(spark):
    s = "id string, relevance long, ord long, signature string, code string"
    a, b = spark.createDataFrame([("x", 1, 5, "sig", None)], s), spark.createDataFrame([("x", 3, 9, None, "code")], s)
    assert rows(relational.merge_candidates([a, b])) == [("x", 3, 5, "sig", "code")]


def test_containment(tmp_path):
    (tmp_path / "in").mkdir()
    assert W.contained("in", str(tmp_path)) == os.path.realpath(tmp_path / "in")
    for bad in ("../x", "/etc/passwd", "in/../../y", "a\0b"):
        with pytest.raises(W.PathTraversal):
            W.contained(bad, str(tmp_path))


def test_file_scan(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "sub/b.ts": "let y\n", ".hid/c.py": "z\n", "build/d.py": "q\n", "big.py": "#" * 300}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = W.files(spark, str(tmp_path), patterns=["build/"], largest=200)
    assert rows(got.select("path", "language")) == [("a.py", "python"), ("sub/b.ts", "typescript")]
    assert rows(W.files(spark, str(tmp_path), ["python"], ["build/"], largest=200).select("text")) == [("x = 1\n",)]
    with pytest.raises(ValueError, match="unknown"):
        W.files(spark, str(tmp_path), ["cobol"])


def test_truncation_goes_back_to_a_blank_line():
    assert formats.truncated("a\nb\n\nc\nd", most_lines=4) == "a\nb\n... [3 lines cut]"
    assert formats.truncated("a\nb", most_lines=4) == "a\nb"


def test_supersession_walks_the_links(spark, tmp_path):
    """A chain with a gap ends before it; the query does the same on a part table without some keys; conflicts and cycles raise."""
    from tessera import registry

    keys = [k for k in range(2600) if k not in (3, 1004, 505)]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for first in (k for k in keys if k < 500):
        end = first
        while end + 500 in keys:
            end += 500
        want.add((first, end, (end - first) // 500))
    assert {tuple(r) for r in registry.queries()["gra_16_supersession"](spark, str(tmp_path)).collect()} == want
    table = lambda rows: spark.createDataFrame(rows, "id long, superseded_by long")
    start = table([(1, None)])
    assert [tuple(r) for r in graph.supersession(table([(1, 7), (7, 2), (2, None)]), start).collect()] == [(1, 2, 2)]
    with pytest.raises(ValueError, match="superseded by 2"):
        graph.supersession(table([(1, 2), (1, 3), (2, None), (3, None)]), start)
    with pytest.raises(RuntimeError, match="cycle"):
        graph.supersession(table([(1, 2), (2, 1)]), start, most_rounds=3)
