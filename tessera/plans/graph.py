"""Graph queries over customers as functions and orders as calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.registry import query
from tessera.standins import EDGES, edges, table

_BFS = "WITH RECURSIVE {edges}, r(node, depth) AS (SELECT CAST({start} AS BIGINT), 0 UNION SELECT {to}, depth + 1 FROM r JOIN v_edges ON {at} = node WHERE depth < {most}), m AS (SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node)"


def _sql(start: int, most: int, back: bool = False, edges: str = EDGES) -> str:
    return _BFS.format(edges=edges, start=start, to="src" if back else "dst", at="dst" if back else "src", most=most)


def _start(spark: SparkSession, *nodes: int) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node long")


@query("gra_01_forward", _sql(1001, 3) + " SELECT * FROM m")
def gra_01(spark: SparkSession, sf: str) -> DataFrame:
    return G.reach(edges(spark, sf), _start(spark, 1001), 3).select("node", "depth")


@query("gra_02_signatures", _sql(1001, 2) + " SELECT node, depth, c_name AS signature FROM m LEFT JOIN customer ON c_custkey = node")
def gra_02(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("signature"))
    return G.reach(edges(spark, sf), _start(spark, 1001), 2).select("node", "depth").join(names, "node", "left")


@query("gra_03_caller_tree", _sql(40, 3, True) + """, p AS (SELECT m.node, m.depth, min(e.dst) AS parent FROM m LEFT JOIN v_edges e ON e.src = m.node AND e.dst IN (SELECT node FROM m k WHERE k.depth = m.depth - 1) GROUP BY m.node, m.depth),
 c AS (SELECT dst AS node, count(*) AS caller_count FROM v_edges GROUP BY dst) SELECT p.node, depth, CASE WHEN depth > 0 THEN parent END AS parent, coalesce(caller_count, 0) AS caller_count, depth = 3 AND coalesce(caller_count, 0) > 0 AS truncated FROM p LEFT JOIN c USING (node)""")
def gra_03(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    counts = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("caller_count"))
    n = F.coalesce("caller_count", F.lit(0))
    return G.reach(G.reversed_edges(e), _start(spark, 40), 3).join(counts, "node", "left").select("node", "depth", "parent", n.alias("caller_count"), ((F.col("depth") == 3) & (n > 0)).alias("truncated"))


@query("gra_04_direct_callers", f"WITH {EDGES} SELECT src AS caller FROM v_edges WHERE dst = 40")
def gra_04(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).filter("dst = 40").select(F.col("src").alias("caller"))


_LABELLED = "v_edges AS (SELECT DISTINCT o_custkey AS src, o_custkey // 2 + o_orderkey % 7 AS dst FROM orders WHERE o_orderstatus <> 'P')"


@query("gra_05_backward_slice", _sql(40, 4, True, _LABELLED) + " SELECT * FROM m")
def gra_05(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("src"), F.expr("o_custkey div 2 + o_orderkey % 7").alias("dst")).distinct()
    return G.reach(G.reversed_edges(e), _start(spark, 40), 4).select("node", "depth")


@query("gra_06_line_dependencies", """WITH e AS (SELECT DISTINCT o_custkey AS src, o_custkey // 2 + o_orderkey % 7 AS dst, o_orderstatus AS kind FROM orders)
 SELECT 'in' AS direction, kind, count(*) AS n FROM e WHERE dst BETWEEN 100 AND 200 GROUP BY kind UNION ALL SELECT 'out', kind, count(*) FROM e WHERE src BETWEEN 100 AND 200 GROUP BY kind""")
def gra_06(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.expr("o_custkey div 2 + o_orderkey % 7").alias("dst"), F.col("o_orderstatus").alias("kind")).distinct()
    side = lambda name, col: e.filter(F.col(col).between(100, 200)).groupBy(F.lit(name).alias("direction"), "kind").agg(F.count("*").alias("n"))
    return side("in", "dst").unionByName(side("out", "src"))


@query("gra_09_neighbourhood", "WITH RECURSIVE " + EDGES + """, w AS (SELECT src, dst FROM v_edges UNION SELECT dst, src FROM v_edges), r(node, depth) AS (SELECT CAST(700 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM r JOIN w ON src = node WHERE depth < 2)
 SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node""")
def gra_09(spark: SparkSession, sf: str) -> DataFrame:
    return G.reach(G.both_ways(edges(spark, sf)), _start(spark, 700), 2).select("node", "depth")


@query("gra_10_affected_tests", _sql(40, 5, True) + " SELECT node, depth FROM m JOIN customer ON c_custkey = node WHERE c_mktsegment = 'BUILDING'")
def gra_10(spark: SparkSession, sf: str) -> DataFrame:
    tests = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))
    return G.reach(G.reversed_edges(edges(spark, sf)), _start(spark, 40), 5).select("node", "depth").join(tests, "node", "left_semi")


@query("gra_11_invalidation", "WITH RECURSIVE " + EDGES + ", r(node) AS (SELECT CAST(3 AS BIGINT) UNION SELECT src FROM r JOIN v_edges ON dst = node) SELECT node FROM r")
def gra_11(spark: SparkSession, sf: str) -> DataFrame:
    return G.closure(G.reversed_edges(edges(spark, sf)), _start(spark, 3)).select("node")


@query("gra_12_still_valid", "WITH RECURSIVE " + EDGES + ", r(node) AS (SELECT CAST(900 AS BIGINT) UNION SELECT src FROM r JOIN v_edges ON dst = node) SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT node FROM r)")
def gra_12(spark: SparkSession, sf: str) -> DataFrame:
    stale = G.closure(G.reversed_edges(edges(spark, sf)), _start(spark, 900))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("node")).join(stale, "node", "left_anti")


@query("gra_13_ready_steps", """WITH done AS (SELECT s_suppkey AS step FROM supplier WHERE s_acctbal > 0)
 SELECT l_orderkey AS step FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey HAVING bool_and(l_suppkey IN (SELECT step FROM done)) AND l_orderkey NOT IN (SELECT step FROM done)""")
def gra_13(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderkey").alias("step")).agg(F.collect_set("l_suppkey").alias("depends_on"))
    done = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("step"))
    return G.ready_steps(steps, done).select("step")


@query("gra_15_version_chain", """WITH RECURSIVE s AS (SELECT c_custkey AS stack_id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent_id FROM customer), r(node, depth) AS (SELECT CAST(1400 AS BIGINT), 0 UNION ALL SELECT parent_id, depth + 1 FROM r JOIN s ON stack_id = node WHERE parent_id IS NOT NULL) SELECT node, CAST(depth AS BIGINT) AS depth FROM r""")
def gra_15(spark: SparkSession, sf: str) -> DataFrame:
    return G.ancestry(_stacks(spark, sf), _start(spark, 1400))


def _stacks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("stack_id"), F.expr("case when c_custkey > 1 then c_custkey div 2 end").alias("parent_id"))


@query("set_05_layered_edges", """WITH RECURSIVE s AS (SELECT c_custkey AS stack_id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent_id FROM customer), r(node, depth) AS (SELECT CAST(1400 AS BIGINT), 0 UNION ALL SELECT parent_id, depth + 1 FROM r JOIN s ON stack_id = node WHERE parent_id IS NOT NULL),
 l AS (SELECT o_orderkey % 97 AS edge_id, depth, CASE WHEN o_orderstatus = 'P' THEN 'delete' ELSE 'add' END AS op FROM orders JOIN r ON o_custkey = node)
 SELECT edge_id, CAST(depth AS BIGINT) AS depth FROM l QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY depth, op DESC) = 1 AND op = 'add'""")
def set_05(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("stack_id"), (F.col("o_orderkey") % 97).alias("edge_id"), F.when(F.col("o_orderstatus") == "P", "delete").otherwise("add").alias("op"))
    return G.visible_edges(log, G.ancestry(_stacks(spark, sf), _start(spark, 1400)))


@query("gra_16_supersession", """WITH RECURSIVE s AS (SELECT p_partkey AS id, p_partkey + 500 AS next FROM part), r(first, id, steps) AS (SELECT id, id, 0 FROM s WHERE id < 500 UNION ALL SELECT first, s.next, steps + 1 FROM r JOIN s ON s.id = r.id JOIN part ON p_partkey = s.next)
 SELECT first, max(id) AS current, CAST(max(steps) AS BIGINT) AS steps FROM r GROUP BY first""")
def gra_16(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions that replace each other: each chain's last one, by the links themselves."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 500).alias("superseded_by"))
    return G.supersession(p, p.filter("id < 500"))


@query("jon_18_dead_code", f"WITH {EDGES} SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT dst FROM v_edges) AND c_custkey NOT IN (SELECT src FROM v_edges) AND NOT regexp_matches(c_name, '00[123]$')")
def jon_18(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "customer").filter("not c_name rlike '00[123]$'").select(F.col("c_custkey").alias("node"))
    return G.dead(nodes, edges(spark, sf))


@query("agg_10_layers", f"WITH {EDGES}, e AS (SELECT src AS node, 1 AS o, 0 AS i FROM v_edges UNION ALL SELECT dst, 0, 1 FROM v_edges), d AS (SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM e GROUP BY node) SELECT *, CASE WHEN n_in = 0 THEN 'entry' WHEN n_out = 0 THEN 'leaf' ELSE 'middle' END AS layer FROM d")
def agg_10(spark: SparkSession, sf: str) -> DataFrame:
    return G.layers(edges(spark, sf))


_CALLS = f"{EDGES}, calls AS (SELECT a.c_nationkey AS src_group, b.c_nationkey AS dst_group, count(*) AS calls FROM v_edges JOIN customer a ON a.c_custkey = src JOIN customer b ON b.c_custkey = dst WHERE a.c_nationkey <> b.c_nationkey GROUP BY ALL)"


def _group_calls(spark: SparkSession, sf: str) -> DataFrame:
    return G.group_calls(edges(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("grp")))


@query("agg_10_group_calls", f"WITH {_CALLS} SELECT * FROM calls")
def agg_10_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _group_calls(spark, sf)


@query("agg_10_group_levels", f"WITH {_CALLS}, d AS (SELECT src_group AS grp, calls AS o, 0 AS i FROM calls UNION ALL SELECT dst_group, 0, calls FROM calls), s AS (SELECT grp, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM d GROUP BY grp) SELECT *, CASE WHEN n_out >= 2 * n_in THEN 'HIGH' WHEN n_in >= 2 * n_out THEN 'LOW' ELSE 'MIDDLE' END AS level FROM s")
def agg_10_levels(spark: SparkSession, sf: str) -> DataFrame:
    return G.group_layers(_group_calls(spark, sf))


@query("agg_10_mutual", f"WITH {_CALLS} SELECT DISTINCT a.src_group AS a, a.dst_group AS b FROM calls a JOIN calls b ON a.src_group = b.dst_group AND a.dst_group = b.src_group WHERE a.src_group < a.dst_group")
def agg_10_mutual(spark: SparkSession, sf: str) -> DataFrame:
    return G.mutual(_group_calls(spark, sf))


_LIST = "array_to_string(list_sort(list({0}))[1:5], ',')"


@query("agg_27_adjacency", f"WITH {EDGES}, o AS (SELECT src AS node, count(*) AS n_callees, {_LIST.format('dst')} AS callees FROM v_edges GROUP BY src), i AS (SELECT dst AS node, {_LIST.format('src')} AS callers FROM v_edges GROUP BY dst) SELECT node, coalesce(n_callees, 0) AS n_callees, callees, callers FROM o FULL JOIN i USING (node)")
def agg_27(spark: SparkSession, sf: str) -> DataFrame:
    a = G.adjacency(edges(spark, sf))
    text = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return a.select("node", "n_callees", text("callees"), text("callers"))


@query("jon_29_neighbourhood", f"""WITH {EDGES}, ch AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal < -900), a AS (SELECT node, 0 AS p FROM ch UNION ALL SELECT dst, 1 FROM v_edges JOIN ch ON node = src UNION ALL SELECT src, 2 FROM v_edges JOIN ch ON node = dst)
 SELECT node, CASE min(p) WHEN 0 THEN 'changed' WHEN 1 THEN 'callee' ELSE 'caller' END AS relation FROM a GROUP BY node""")
def jon_29(spark: SparkSession, sf: str) -> DataFrame:
    changed = table(spark, sf, "customer").filter("c_acctbal < -900").select(F.col("c_custkey").alias("node"))
    return G.neighbourhood(edges(spark, sf), changed)


@query("jon_30_signatures", f"""WITH {EDGES}, ch AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal < -900), a AS (SELECT node, 0 AS p FROM ch UNION ALL SELECT dst, 1 FROM v_edges JOIN ch ON node = src UNION ALL SELECT src, 2 FROM v_edges JOIN ch ON node = dst)
 SELECT node, CASE min(p) WHEN 0 THEN 'changed' WHEN 1 THEN 'callee' ELSE 'caller' END AS relation, any_value(c_name) AS signature FROM a LEFT JOIN customer ON c_custkey = node GROUP BY node""")
def jon_30(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("signature"))
    return jon_29(spark, sf).join(names, "node", "left")
