"""Packing queries: the orders of a customer as the candidates of a pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import packing as P
from tessera.registry import query
from tessera.standins import LINES, lines, table

_FOLD = """o AS (SELECT o_custkey AS pack, o_orderkey AS id, round(o_totalprice, 0) AS f, round(o_totalprice / 10, 0) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
 w(pack, r, id, used, choice) AS (SELECT DISTINCT pack, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0::DOUBLE, 'start' FROM o UNION ALL
 SELECT o.pack, o.r, o.id, w.used + CASE WHEN w.used + f <= {b} THEN f WHEN w.used + s <= {b} THEN s ELSE 0 END, CASE WHEN w.used + f <= {b} THEN 'full' WHEN w.used + s <= {b} THEN 'sig' ELSE 'stop' END FROM w JOIN o ON o.pack = w.pack AND o.r = w.r + 1 WHERE w.choice <> 'stop')"""


def _packs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("pack"), F.col("o_orderkey").alias("oid"), "o_orderdate", F.round("o_totalprice", 0).alias("full"), F.round(F.col("o_totalprice") / 10, 0).alias("sig"))


@query("pck_01_greedy", "WITH RECURSIVE " + _FOLD.format(b=800000) + " SELECT pack, r AS pos, id, choice, round(used, 4) AS used FROM w WHERE choice IN ('full', 'sig')")
def pck_01(spark: SparkSession, sf: str) -> DataFrame:
    return P.greedy(_packs(spark, sf), "pack", ["o_orderdate", "oid"], "oid", "full", "sig", F.lit(800000))


@query("pck_02_delta_pack", "WITH RECURSIVE " + _FOLD.format(b=500000).replace("round(o_totalprice, 0) AS f", "CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice / 10, 0) ELSE round(o_totalprice, 0) END AS f") + " SELECT pack, r AS pos, id, choice, round(used, 4) AS used FROM w WHERE choice IN ('full', 'sig')")
def pck_02(spark: SparkSession, sf: str) -> DataFrame:
    """Unchanged symbols (status F) cost their signature, as their body was sent before."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("pack"), F.col("o_orderkey").alias("oid"), "o_orderdate", "o_orderstatus", F.round("o_totalprice", 0).alias("full"), F.round(F.col("o_totalprice") / 10, 0).alias("sig"))
    return P.greedy(o.withColumn("full", F.when(F.col("o_orderstatus") == "F", F.col("sig")).otherwise(F.col("full"))), "pack", ["o_orderdate", "oid"], "oid", "full", "sig", F.lit(500000))


@query("pck_04_knapsack")
def pck_04(spark: SparkSession, sf: str) -> DataFrame:
    ln = table(spark, sf, "lineitem")
    b = ln.select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("block"), F.col("l_quantity").cast("int").alias("cost"), F.round(F.col("l_extendedprice") / 1000, 1).alias("score"), (F.col("l_returnflag") == "R").alias("must"))
    return P.knapsack(b, "fn", 80)


#: All sets of an order's blocks, by brute force: must-keep ones are paid for first, the best of the rest that fits is added.
_SETS = """WITH b AS (SELECT l_orderkey AS fn, CAST(l_quantity AS INTEGER) AS cost, round(l_extendedprice / 1000, 1) AS score, l_returnflag = 'R' AS must, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber) - 1 AS k FROM lineitem),
 p AS (SELECT fn, coalesce(sum(cost) FILTER (must), 0) AS paid, coalesce(sum(score) FILTER (must), 0) AS had, count(*) FILTER (NOT must) AS n FROM b GROUP BY fn),
 s AS (SELECT fn, paid, had, unnest(range(0, 1 << CAST(n AS INTEGER))) AS m FROM p),
 v AS (SELECT s.fn, s.m, any_value(paid) AS paid, any_value(had) AS had, coalesce(sum(cost), 0) AS cost, coalesce(sum(score), 0) AS score FROM s LEFT JOIN b ON b.fn = s.fn AND NOT must AND (s.m >> CAST(k AS INTEGER)) & 1 = 1 GROUP BY s.fn, s.m)
 SELECT fn, round(any_value(had) + max(score) FILTER (cost = 0 OR paid + cost <= {budget}), 1) AS score, any_value(paid) <= {budget} AS musts_fit FROM v GROUP BY fn"""


@query("pck_04_knapsack_totals", _SETS.format(budget=80))
def pck_04_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The score that the knapsack reaches, against all sets of blocks."""
    ln = table(spark, sf, "lineitem")
    own = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag"))
    b = ln.select(F.col("l_orderkey").alias("fn"), own.alias("block"), F.col("l_quantity").cast("int").alias("cost"), F.round(F.col("l_extendedprice") / 1000, 1).alias("score"), (F.col("l_returnflag") == "R").alias("must"))
    kept = P.knapsack(b, "fn", 80).join(b, ["fn", "block"])
    score = F.round(F.sum(F.when(F.col("kept"), F.col("score")).otherwise(0.0)), 1)
    return kept.groupBy("fn").agg(score.alias("score"), (F.coalesce(F.sum(F.when(F.col("must"), F.col("cost"))), F.lit(0)) <= 80).alias("musts_fit"))


@query("pck_03_budget_again", "WITH RECURSIVE " + _FOLD.format(b=300000).replace("round(o_totalprice, 0) AS f", "round(o_totalprice * 1.1, 0) AS f") + " SELECT pack, r AS pos, id, choice, round(used, 4) AS used FROM w WHERE choice IN ('full', 'sig')")
def pck_03(spark: SparkSession, sf: str) -> DataFrame:
    """The budget once more over slices whose bodies were read anew and grew by a tenth."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("pack"), F.col("o_orderkey").alias("oid"), "o_orderdate", F.round(F.col("o_totalprice") * 1.1, 0).alias("full"), F.round(F.col("o_totalprice") / 10, 0).alias("sig"))
    return P.greedy(o, "pack", ["o_orderdate", "oid"], "oid", "full", "sig", F.lit(300000))


@query("pck_06_two_stage")
def pck_06(spark: SparkSession, sf: str) -> DataFrame:
    ln = table(spark, sf, "lineitem")
    b = ln.select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("block"), F.col("l_quantity").cast("int").alias("cost"), F.round(F.col("l_extendedprice") / 1000, 1).alias("score"), (F.col("l_returnflag") == "R").alias("must"))
    return P.knapsack(b, "fn", 120, most_blocks=3)


@query("pck_07_line_budget", f"WITH {LINES} SELECT doc_id, count(*) FILTER (pos <= 4) AS kept, count(*) > 4 AS cut FROM v_lines GROUP BY doc_id")
def pck_07(spark: SparkSession, sf: str) -> DataFrame:
    return P.line_budget(lines(spark, sf), "doc_id", 4)


@query("pck_08_call_caps", "SELECT doc_id, CASE WHEN n_chars < 500 THEN 3 WHEN n_chars < 1000 THEN 5 WHEN n_chars < 2000 THEN 8 WHEN n_chars < 5000 THEN 12 ELSE 20 END AS cap FROM documents")
def pck_08(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", P.call_cap(F.col("n_chars")).alias("cap"))


@query("top_01_candidate_order", "SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_retailprice, p_partkey) AS pos FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 100")
def top_01(spark: SparkSession, sf: str) -> DataFrame:
    keys = [F.desc("p_size"), "p_retailprice", "p_partkey"]
    first = table(spark, sf, "part").orderBy(*keys).limit(100)
    return first.select(F.col("p_partkey").alias("id"), F.row_number().over(W.orderBy(*keys)).cast("long").alias("pos"))


@query("snk_05_columnar", "SELECT conv_id, to_json(list(role ORDER BY turn)) AS roles, to_json(list(turn ORDER BY turn)) AS turns FROM conversations GROUP BY conv_id")
def snk_05(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return c.select("conv_id", F.to_json("x.role").alias("roles"), F.to_json("x.turn").alias("turns"))


@query("snk_07_cache_prefix", "SELECT p_brand AS file, sha256(string_agg(p_partkey || ' ' || p_name, chr(10) ORDER BY p_partkey)) AS prefix_hash FROM part GROUP BY 1")
def snk_07(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("file")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    return p.select("file", F.sha2(F.array_join(F.transform("x", lambda s: F.concat_ws(" ", s.p_partkey.cast("string"), s.p_name)), "\n"), 256).alias("prefix_hash"))


@query("snk_08_truncate", f"""WITH {LINES}, r AS (SELECT doc_id, pos, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM v_lines) SELECT doc_id, max(pos) FILTER (run <= 2000) AS last_line, count(*) FILTER (run > 2000) AS dropped FROM r GROUP BY doc_id""")
def snk_08(spark: SparkSession, sf: str) -> DataFrame:
    run = F.sum(F.octet_length("line") + 1).over(W.partitionBy("doc_id").orderBy("pos"))
    r = lines(spark, sf).select("doc_id", "pos", run.alias("run"))
    return r.groupBy("doc_id").agg(F.max(F.when(F.col("run") <= 2000, F.col("pos"))).alias("last_line"), F.count_if(F.col("run") > 2000).alias("dropped"))


@query("snk_15_blob_put", "SELECT sha256(text) AS hash, max(strlen(text)) AS size FROM documents GROUP BY 1 HAVING sha256(any_value(text)) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def snk_15(spark: SparkSession, sf: str) -> DataFrame:
    """New content only: an anti-join on the content hash against what is stored (source src0)."""
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"), "source")
    return d.join(d.filter("source = 'src0'").select("hash"), "hash", "left_anti").groupBy("hash").agg(F.max("size").alias("size"))
