"""Joins, windows, sets and projections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import relational as R
from tessera.registry import query
from tessera.shared import spread
from tessera.standins import HUNKS, LINES, SYMBOLS, hunks, lines, outcomes, symbols, table

_FN = "p AS (SELECT p_brand || '/' || p_name AS file, p_type AS name FROM part), x AS (SELECT replace(file, '/', '.') AS module_key, name, file FROM p UNION SELECT regexp_extract(replace(file, '/', '.'), '[^.]*$'), name, file FROM p)"


@query("jon_05_function_index", f"WITH {_FN} SELECT module_key, name, max(file) AS file FROM x GROUP BY ALL")
def jon_05(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("file"), F.col("p_type").alias("name"))
    return R.function_index(p)


@query("jon_01_call_resolution", """WITH c AS (SELECT l_orderkey AS caller, l_partkey AS target, l_suppkey AS module FROM lineitem), k AS (SELECT p_partkey, p_brand FROM part WHERE p_size <= 25), s AS (SELECT s_suppkey, s_name FROM supplier)
 SELECT DISTINCT caller, coalesce(p_brand, s_name) AS dst_file, target AS dst_func FROM c LEFT JOIN k ON p_partkey = target LEFT JOIN s ON s_suppkey = module WHERE coalesce(p_brand, s_name) IS NOT NULL""")
def jon_01(spark: SparkSession, sf: str) -> DataFrame:
    """The shape of call resolution: a first key, a second as fallback, unresolved rows dropped, edges distinct."""
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("module"))
    near = table(spark, sf, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("target"), "p_brand")
    far = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("module"), "s_name")
    j = calls.join(near, "target", "left").join(far, "module", "left").withColumn("dst_file", F.coalesce("p_brand", "s_name"))
    return j.filter("dst_file is not null").select("caller", "dst_file", F.col("target").alias("dst_func")).distinct()


@query("jon_06_symbol_ids", """WITH e AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS func FROM lineitem) SELECT file, func, coalesce(p_name, file || ':' || func) AS symbol_id FROM e LEFT JOIN part ON p_partkey = func AND p_size > 10""")
def jon_06(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("func")).distinct()
    names = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("func"), "p_name")
    return e.join(names, "func", "left").select("file", "func", F.coalesce("p_name", F.concat_ws(":", F.col("file").cast("string"), F.col("func").cast("string"))).alias("symbol_id"))


@query("jon_07_entry_cascade", """WITH c AS (SELECT p_partkey AS id, 1 AS stage FROM part WHERE p_name = 'part 10' UNION ALL SELECT p_partkey, 2 FROM part WHERE p_brand = 'Brand#12' UNION ALL SELECT p_partkey, 3 FROM part WHERE p_type LIKE '%BRASS%'),
 b AS (SELECT id, min(stage) AS stage FROM c GROUP BY id) SELECT id, CAST(stage AS INT) AS stage, row_number() OVER (ORDER BY stage, id) AS rank FROM b WHERE stage = (SELECT min(stage) FROM b)""")
def jon_07(spark: SparkSession, sf: str) -> DataFrame:
    """The first stage of a cascade of look-ups that finds anything."""
    p = table(spark, sf, "part")
    stage = F.when(F.col("p_name") == "part 10", 1).when(F.col("p_brand") == "Brand#12", 2).when(F.col("p_type").like("%BRASS%"), 3)
    found = p.select(F.col("p_partkey").alias("id"), stage.alias("stage")).filter("stage is not null")
    best = found.join(F.broadcast(found.agg(F.min("stage").alias("stage"))), "stage")
    return best.select("id", "stage", F.row_number().over(W.partitionBy("stage").orderBy("id")).cast("long").alias("rank"))


@query("jon_08_interval", f"""WITH {SYMBOLS}, {HUNKS} SELECT hunk, symbol_id, end_line - start_line + 1 AS span FROM v_hunks JOIN v_symbols USING (file) WHERE start_line <= h_end AND end_line >= h_start QUALIFY row_number() OVER (PARTITION BY hunk ORDER BY end_line - start_line + 1, symbol_id) = 1""")
def jon_08(spark: SparkSession, sf: str) -> DataFrame:
    return R.narrowest(hunks(spark, sf), symbols(spark, sf))


@query("jon_10_as_of", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events")
def jon_10(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return R.as_of(e, "user_id", ["ts", "event_id"], F.col("event_type") == "click", "event_id", "last_click").select("event_id", "last_click")


@query("jon_11_as_of_version", "SELECT user_id, max(event_id) FILTER (TRUE) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_id <= 5000 GROUP BY user_id")
def jon_11(spark: SparkSession, sf: str) -> DataFrame:
    return R.as_of_version(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", F.lit(5000), "event_id")


@query("jon_14_signature_diff", "SELECT coalesce(a.p_partkey, b.l_partkey) AS name, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.l_partkey IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM part a FULL JOIN (SELECT l_partkey, max(CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY 1) b ON p_partkey = l_partkey WHERE p_size IS DISTINCT FROM q")
def jon_14(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("signature"))
    new = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.max(F.col("l_quantity").cast("int")).alias("signature"))
    return R.edited_signatures(old, new)


@query("jon_16_dotted_prefix", "SELECT DISTINCT s.s_suppkey AS test FROM supplier s, nation n WHERE s_name = n_name OR starts_with(s_name, n_name || '#') OR (s_nationkey = n_nationkey AND starts_with(n_name, 'nation_1'))")
def jon_16(spark: SparkSession, sf: str) -> DataFrame:
    """A theta semi-join; nations are a table of fixed size, so its side goes to all tasks."""
    s, n = table(spark, sf, "supplier"), F.broadcast(table(spark, sf, "nation"))
    on = (F.col("s_name") == F.col("n_name")) | F.startswith("s_name", F.concat("n_name", F.lit("#"))) | ((F.col("s_nationkey") == F.col("n_nationkey")) & F.startswith("n_name", F.lit("nation_1")))
    return s.join(n, on, "left_semi").select(F.col("s_suppkey").alias("test"))


@query("jon_17_importers", "SELECT DISTINCT l_orderkey AS file FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11')")
def jon_17(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(p, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("file")).distinct()


@query("jon_19_decision_refs", "SELECT o_orderkey AS decision, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS refs FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' GROUP BY 1")
def jon_19(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("decision"))
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("decision"), F.col("l_suppkey").cast("string").alias("ref"))
    return o.join(r, "decision").groupBy("decision").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("refs"))


@query("jon_20_evidence", "SELECT c_custkey AS hypothesis, count(o_orderkey) AS evidence, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE -1.0 END) FILTER (o_orderkey IS NOT NULL), 0.0), 8)::DOUBLE AS weight FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def jon_20(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("hypothesis")).agg(F.count("*").alias("evidence"), F.sum(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0)).alias("weight"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("hypothesis"))
    return c.join(o, "hypothesis", "left").select("hypothesis", F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


@query("jon_28_hydration", f"WITH {LINES}, s AS (SELECT doc_id, greatest(1, doc_id % 5) AS a, doc_id % 5 + 3 AS b FROM documents) SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS body FROM v_lines JOIN s USING (doc_id) WHERE pos BETWEEN a AND b GROUP BY doc_id")
def jon_28(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of line ranges, sliced inside the row: no line becomes a record."""
    a, b = F.greatest(F.lit(1), F.col("doc_id") % 5).cast("int"), (F.col("doc_id") % 5 + 3).cast("int")
    body = F.slice(F.split("text", "\n"), a, b - a + 1)
    return table(spark, sf, "documents").filter(F.size(body) > 0).select("doc_id", F.md5(F.array_join(body, "\n")).alias("body"))


@query("jon_27_paired_grid", """WITH c AS (SELECT o_custkey AS task, o_orderkey % 3 + 1 AS repeat, CASE WHEN o_orderstatus = 'F' THEN 'baseline' ELSE 'adaptive' END AS condition, o_totalprice AS value FROM orders), g AS (SELECT DISTINCT task, r AS repeat FROM c, range(1, 4) t(r)),
 b AS (SELECT task, repeat, count(*) FILTER (condition = 'baseline') AS nb, max(value) FILTER (condition = 'baseline') AS baseline, count(*) FILTER (condition = 'adaptive') AS na, max(value) FILTER (condition = 'adaptive') AS adaptive FROM c GROUP BY ALL)
 SELECT g.task, g.repeat, baseline, adaptive, CASE WHEN nb > 1 OR na > 1 THEN 'duplicate' WHEN nb = 1 AND na = 1 THEN 'complete' ELSE 'incomplete' END AS state FROM g LEFT JOIN b ON b.task = g.task AND b.repeat = g.repeat""")
def jon_27(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 3 + 1).alias("repeat"), F.when(F.col("o_orderstatus") == "F", "baseline").otherwise("adaptive").alias("condition"), F.col("o_totalprice").alias("value"))
    return R.paired_grid(o, 3, o)


@query("win_01_end_lines", f"WITH {SYMBOLS} SELECT symbol_id, start_line, end_line FROM v_symbols")
def win_01(spark: SparkSession, sf: str) -> DataFrame:
    s = symbols(spark, sf).select("symbol_id", "file", "start_line")
    return R.end_lines(s, "file", "start_line", F.col("start_line") + 9).select("symbol_id", "start_line", "end_line")


@query("win_02_merge_windows", f"""WITH {LINES}, w AS (SELECT doc_id, pos - 2 AS a, pos + 2 AS b FROM v_lines WHERE regexp_matches(line, '[0-9]')), f AS (SELECT *, CASE WHEN max(b) OVER p IS NULL OR a > max(b) OVER p + 1 THEN 1 ELSE 0 END AS fresh FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT doc_id, min(a) AS "start", max(b) AS "end" FROM i GROUP BY doc_id, island""")
def win_02(spark: SparkSession, sf: str) -> DataFrame:
    w = lines(spark, sf).filter(F.rlike("line", F.lit("[0-9]"))).select("doc_id", (F.col("pos") - 2).alias("start"), (F.col("pos") + 2).alias("end"))
    return R.merge_windows(w, "doc_id")


@query("win_04_ranges", f"""WITH {LINES}, p AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM v_lines WHERE length(line) > 100) SELECT doc_id, min(pos) AS "start", max(pos) AS "end" FROM p GROUP BY doc_id, island""")
def win_04(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranges(lines(spark, sf).filter(F.length("line") > 100), "doc_id", "pos")


_SEG = f"""{LINES}, i AS (SELECT doc_id, pos, line, length(line) - length(ltrim(line, ' ')) AS indent, trim(line, ' ') = '' AS blank FROM v_lines), f AS (SELECT *, CASE WHEN coalesce(indent <> lag(indent) OVER w OR lag(blank) OVER w, FALSE) THEN 1 ELSE 0 END AS fresh FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 seg AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f)"""


@query("win_06_segments", f"WITH {_SEG} SELECT doc_id, segment, count(*) AS n, min(pos) AS first FROM seg GROUP BY ALL")
def win_06(spark: SparkSession, sf: str) -> DataFrame:
    return R.indent_segments(lines(spark, sf)).groupBy("doc_id", "segment").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query("win_08_block_scores", f"""WITH {LINES}, b AS (SELECT doc_id, pos // 3 AS block, pos, regexp_matches(line, '\\b(for|if|while)\\b') AS control, regexp_matches(line, '[0-9]') AS hit FROM v_lines), g AS (SELECT doc_id, block, count(*) FILTER (hit) AS hits, count(*) FILTER (control) AS control FROM b GROUP BY ALL)
 SELECT doc_id, block, CAST(10.0 * hits + 0.5 * control + CASE WHEN hits = 0 THEN 3.0 * (coalesce((lag(hits) OVER w > 0)::INT, 0) + coalesce((lead(hits) OVER w > 0)::INT, 0)) ELSE 0.0 END AS DOUBLE) AS score FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY block)""")
def win_08(spark: SparkSession, sf: str) -> DataFrame:
    b = lines(spark, sf).select("doc_id", F.expr("pos div 3").alias("block"), "pos", "line", F.rlike("line", F.lit(r"\b(for|if|while)\b")).alias("control"))
    return R.score_blocks(b, b.filter(F.rlike("line", F.lit("[0-9]"))))


@query("set_02_merge_candidates", """WITH a AS (SELECT p_partkey AS id, p_size AS relevance, p_partkey % 7 AS ord, p_name AS signature, NULL::VARCHAR AS code FROM part UNION ALL SELECT l_partkey, CAST(l_quantity AS INT), l_orderkey, NULL, l_returnflag FROM lineitem)
 SELECT id, max(relevance) AS relevance, min(ord) AS ord, arg_min(signature, ord) FILTER (signature IS NOT NULL) AS signature, arg_min(code, ord * 10 + ascii(code) % 10) FILTER (code IS NOT NULL) AS code FROM a GROUP BY id""")
def set_02(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("relevance"), (F.col("p_partkey") % 7).alias("ord"), F.col("p_name").alias("signature"), F.lit(None).cast("string").alias("code"))
    b = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").cast("int").alias("relevance"), F.col("l_orderkey").alias("ord"), F.lit(None).cast("string").alias("signature"), F.col("l_returnflag").alias("code"))
    every = a.unionByName(b)
    code = F.min_by("code", F.when(F.col("code").isNotNull(), F.col("ord") * 10 + F.ascii("code") % 10))
    return every.groupBy("id").agg(F.max("relevance").alias("relevance"), F.min("ord").alias("ord"), F.min_by("signature", F.when(F.col("signature").isNotNull(), F.col("ord"))).alias("signature"), code.alias("code"))


@query("set_06_removed_params", "WITH a AS (SELECT l_orderkey AS k, list_distinct(list(l_partkey)) AS x FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), b AS (SELECT l_orderkey AS k, list_distinct(list(l_partkey)) AS y FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) SELECT a.k AS k, CAST(len(list_filter(x, lambda v: NOT list_contains(y, v))) AS INT) AS removed FROM a JOIN b ON a.k = b.k")
def set_06(spark: SparkSession, sf: str) -> DataFrame:
    ln = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    a = ln.filter("l_linenumber <= 4").groupBy("k").agg(F.collect_set("l_partkey").alias("x"))
    b = ln.filter("l_returnflag <> 'R'").groupBy("k").agg(F.collect_set("l_partkey").alias("y"))
    return a.join(b, "k").select("k", F.size(F.array_except("x", "y")).alias("removed"))


@query("set_07_removed_symbols", "SELECT DISTINCT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 30 AND l_discount > 0.08")
def set_07(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id")).subtract(table(spark, sf, "lineitem").filter("l_quantity >= 30 and l_discount > 0.08").select("l_partkey"))


@query("set_08_ordered_dedup", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def set_08(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x.role), ",").alias("roles"))


@query("set_09_union", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT s_suppkey FROM supplier")
def set_09(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return a.union(table(spark, sf, "customer").filter("c_acctbal < 0").select("c_custkey")).union(table(spark, sf, "supplier").select("s_suppkey")).distinct()


@query("set_10_edge_dedup", "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS relation FROM lineitem")
def set_10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation")).distinct()


@query("set_11_promotion", "SELECT p_brand AS class, count(*) AS members FROM part WHERE p_size = 7 GROUP BY 1 HAVING count(*) > 1")
def set_11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter("p_size = 7").groupBy(F.col("p_brand").alias("class")).agg(F.count("*").alias("members")).filter("members > 1")


@query("agg_09_import_frequency", r"""WITH w AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents), n AS (SELECT count(DISTINCT source) AS n FROM documents) SELECT term, count(*) AS files FROM w GROUP BY term HAVING count(*) > 0.5 * (SELECT n FROM n)""")
def agg_09(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that over half of the sources import. Terms are made distinct in the row before the shuffle."""
    d = table(spark, sf, "documents")
    w = spread(d.select("source", "text")).select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0))).alias("term")).distinct()
    n = d.agg(F.countDistinct("source").alias("n"))
    return w.groupBy("term").agg(F.count("*").alias("files")).crossJoin(F.broadcast(n)).filter("files > 0.5 * n").select("term", "files")


@query("agg_11_caller_groups", "SELECT p_type || '/' || p_size AS pattern, count(*) AS n, arg_min(p_name, p_partkey) AS exemplar FROM part GROUP BY 1")
def agg_11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("pattern")).agg(F.count("*").alias("n"), F.min_by("p_name", "p_partkey").alias("exemplar"))


@query("agg_26_impact_summary", "SELECT count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F') AS affected, count(DISTINCT o_custkey) AS total, greatest(0, count(DISTINCT o_custkey) - count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F')) AS skipped FROM orders")
def agg_26(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").agg(F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("affected"), F.countDistinct("o_custkey").alias("total"))
    return a.withColumn("skipped", F.greatest(F.lit(0), F.col("total") - F.col("affected")))


@query("agg_29_tokens", "SELECT source, CAST(sum(greatest(1, floor(length(text) / 4))) AS BIGINT) AS tokens FROM documents GROUP BY source")
def agg_29(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query("prj_07_test_files", r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '(^|/)(test_[^/]*|[^/]*_test)(\.|$)') OR regexp_matches(url, '/(tests?|__tests__)/') OR regexp_matches(url, '[13579]$')")
def prj_07(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").filter(url.rlike(r"(^|/)(test_[^/]*|[^/]*_test)(\.|$)") | F.arrays_overlap(F.slice(F.split(url, "/"), 1, F.greatest(F.lit(0), F.size(F.split(url, "/")) - 1)), F.array(F.lit("test"), F.lit("tests"), F.lit("__tests__"))) | url.rlike("[13579]$")).select("page_id", "url")


@query("prj_14_invariants", f"""WITH {LINES} SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^\\s*assert\\b') THEN 'assertion' WHEN regexp_matches(line, '^\\s*@\\w') THEN 'decorator' WHEN regexp_matches(line, '^[A-Z][A-Z0-9_]+ *=') THEN 'constant' ELSE 'hint' END AS kind FROM v_lines WHERE regexp_matches(line, '^\\s*assert\\b') OR regexp_matches(line, '^\\s*@\\w') OR regexp_matches(line, '^[A-Z][A-Z0-9_]+ *=') OR regexp_matches(line, '\\w+: \\w+')""")
def prj_14(spark: SparkSession, sf: str) -> DataFrame:
    is_ = lambda p: F.rlike("line", F.lit(p))
    kind = F.when(is_(r"^\s*assert\b"), "assertion").when(is_(r"^\s*@\w"), "decorator").when(is_(r"^[A-Z][A-Z0-9_]+ *="), "constant").when(is_(r"\w+: \w+"), "hint")
    return lines(spark, sf).select("doc_id", "pos", kind.alias("kind")).filter("kind is not null")


@query("prj_18_list_filters", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '%HIGH%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def prj_18(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_orderpriority like '%HIGH%'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return o.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))


@query("prj_19_prefix_lookup", "SELECT doc_id FROM documents WHERE starts_with(sha256(text), 'ab')")
def prj_19(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter(F.startswith(F.sha2("text", 256), F.lit("ab"))).select("doc_id")


@query("prj_23_chunk_summary", f"WITH {LINES}, f AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM v_lines WHERE pos <= 12 AND regexp_matches(line, '=|\\|')) SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS summary FROM f WHERE r <= 6 GROUP BY doc_id")
def prj_23(spark: SparkSession, sf: str) -> DataFrame:
    s = F.slice(F.filter(F.slice(F.split("text", "\n"), 1, 12), lambda x: x.rlike(r"=|\|")), 1, 6)
    return table(spark, sf, "documents").filter(F.size(s) > 0).select("doc_id", F.md5(F.array_join(s, "\n")).alias("summary"))


@query("fun_03_cleaners", r"SELECT page_id, array_to_string(string_split(url, '/')[-3:], '/') AS short, length(CASE WHEN length(trim(regexp_replace(html, '\s+', ' ', 'g'))) > 800 THEN rtrim(substring(trim(regexp_replace(html, '\s+', ' ', 'g')), 1, 800)) || '...' ELSE trim(regexp_replace(html, '\s+', ' ', 'g')) END) AS n FROM pages")
def fun_03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.short_path(F.col("url")).alias("short"), F.length(T.squeeze(F.col("html"))).cast("long").alias("n"))


@query("fun_04_hashes", "SELECT doc_id, substring(sha256(text), 1, 16) AS id, md5(text) AS cache_key, sha1(text) AS content FROM documents")
def fun_04(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.short_hash(t).alias("id"), F.md5(t).alias("cache_key"), F.sha1(t).alias("content"))


@query("fun_10_savings", "SELECT o_orderkey AS id, round(1 - o_totalprice / 500000, 8) AS saved, round(500000 / o_totalprice, 8) AS ratio FROM orders")
def fun_10(spark: SparkSession, sf: str) -> DataFrame:
    p, b = F.col("o_totalprice"), F.lit(500000.0)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(T.savings(p, b), 8).alias("saved"), F.round(T.ratio(p, b), 8).alias("ratio"))
