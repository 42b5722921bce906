"""Names, signatures, paths, packs and logs: queries on fixtures, with the rows they must give, and on the driver's tables."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import code as C
from tessera.functions import text as T
from tessera.operators import packing as P
from tessera.operators import relational as R
from tessera.operators import state as S
from tessera.parse import python_facts as Y
from tessera.plans.code import PROJECT, _rows, call_graph, facts, project
from tessera.registry import query
from tessera.standins import LINES, deliveries, lines, table


def _frame(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


@query("fun_02_terms", _rows("word, term", ("Calling", "call"), ("duplicates", "dedup"), ("normalization", "normal"), ("walked", "walk"), ("this", None), ("of", None), ("appending", "insert"), ("truncation", "truncate"), ("blocks", "block"), ("sites", "site")))
def fun_02(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, "word string", *[(w,) for w in ("Calling", "duplicates", "normalization", "walked", "this", "of", "appending", "truncation", "blocks", "sites")])
    return d.select("word", C.canonical_term(F.col("word")).alias("term"))


@query("fun_05_signatures", _rows("lang, sig", ("python", "def f(a: int) -> str"), ("go", "func f(a: int) str"), ("rust", "fn f(a: int) -> str"), ("ruby", "def f(a: int)"), ("kotlin", "fun f(a: int): str"), ("other", "f()")))
def fun_05(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, "lang string", *[(x,) for x in ("python", "go", "rust", "ruby", "kotlin", "other")])
    return d.select("lang", C.render_signature(F.col("lang"), F.lit("f"), F.array(F.lit("a: int")), F.lit("str")).alias("sig"))


@query("fun_06_import_statements", _rows("module, name", ("a.b", "c"), ("a.b", "d"), ("os", None)))
def fun_06(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, "line string", ("from a.b import c, d",), ("import os",))
    frm = F.regexp_extract("line", r"^from\s+([\w.]+)\s+import", 1)
    names = F.when(frm != "", F.transform(F.split(F.regexp_extract("line", r"\simport\s+(.*)$", 1), ","), lambda x: F.trim(x))).otherwise(F.array(F.lit(None).cast("string")))
    return d.select(F.when(frm != "", frm).otherwise(F.regexp_extract("line", r"^import\s+([\w.]+)", 1)).alias("module"), F.explode(names).alias("name"))


@query("fun_07_module_names", _rows("path, module", ("pkg/mod.py", "pkg.mod"), ("pkg/__init__.py", "pkg"), ("top.py", "top")))
def fun_07(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, "path string", ("pkg/mod.py",), ("pkg/__init__.py",), ("top.py",))
    return d.select("path", T.module_name(F.col("path")).alias("module"))


_SIGS = [("def run(self, a: Dict[str, int], b=2) -> None",), ("async def go()",), ("fn main(x: i32)",), ("int sum(int a, int b)",), ("nothing",)]


@query("fun_08_patterns", _rows("pattern", ("run/2",), ("go/0",), ("main/1",), ("sum/2",), ("unknown/0",)))
def fun_08(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, "sig string", *_SIGS).select(C.call_pattern(F.col("sig")).alias("pattern"))


@query("fun_09_references", "SELECT doc_id, sha256(text) AS hash, lang AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents")
def fun_09(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("vhs://"), F.sha2("text", 256)).alias("r"), F.concat_ws(":", "lang", F.col("doc_id").cast("string")).alias("t"))
    return d.select("doc_id", T.hex64(F.col("r")).alias("hash"), F.substring_index("t", ":", 1).alias("kind"), F.substring_index("t", ":", -1).alias("id"))


@query("fun_12_relevance", "SELECT l_returnflag AS label, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS relevance, count(*) AS n FROM lineitem GROUP BY ALL")
def fun_12(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for x in ("R", 3, "A", 2)])
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n")).select("label", F.coalesce(rank[F.col("label")], F.lit(1)).alias("relevance"), "n")


@query("fun_13_compatible", _rows("was, now, ok", ("None", "Optional[int]", True), ("int", "int | str", True), ("str", "int", False)))
def fun_13(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, "was string, now string", ("None", "Optional[int]"), ("int", "int | str"), ("str", "int"))
    return d.withColumn("ok", C.compatible_return(F.col("was"), F.col("now")))


@query("fun_14_fingerprints", "SELECT user_id AS session, substring(sha256(user_id || '|' || count(*) || '|' || max(event_id)), 1, 16) AS fingerprint FROM events GROUP BY user_id")
def fun_14(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("session")).agg(F.count("*").alias("n"), F.max("event_id").alias("m"))
    return e.select("session", T.short_hash(F.concat_ws("|", *[F.col(c).cast("string") for c in ("session", "n", "m")])).alias("fingerprint"))


@query("fun_15_durations", "SELECT event_id, CASE WHEN v < 10 THEN v * 1000 || 'ms' WHEN v < 60 THEN v || 's' ELSE v // 60 || 'm' END AS d FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS v FROM events)")
def fun_15(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    d = table(spark, sf, "events").select("event_id", F.floor("value").cast("long").alias("v"))
    return d.select("event_id", F.when(v < 10, F.concat((v * 1000).cast("string"), F.lit("ms"))).when(v < 60, F.concat(v.cast("string"), F.lit("s"))).otherwise(F.concat(F.expr("v div 60").cast("string"), F.lit("m"))).alias("d"))


@query("fun_16_uncached", "SELECT l_orderkey AS run, CAST(greatest(0, sum(CAST(l_quantity AS BIGINT)) - coalesce(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END), 0)) AS BIGINT) AS uncached, round(1 - count(DISTINCT l_suppkey) / count(*), 8) AS repeated FROM lineitem GROUP BY 1")
def fun_16(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.greatest(F.lit(0), F.sum(q) - F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", q)), F.lit(0))).alias("uncached"), F.count("*").alias("n"), F.size(F.collect_set("l_suppkey")).alias("d"))
    return a.select("run", "uncached", F.round(1 - F.col("d") / F.col("n"), 8).alias("repeated"))


@query("prj_02_structure", _rows("file, functions, classes, imports", ("a.py", "farewell,greet", "", ""), ("b.py", "", "Greeter", "a"), ("flow.py", "main,total", "", "a,os")))
def prj_02(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark)
    names = lambda cond, c: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col(c)))), ",")
    sym = F.col("fact") == "symbol"
    return f.filter("fact in ('symbol', 'import')").groupBy("file").agg(names(sym & (F.col("kind") == "function"), "name").alias("functions"), names(sym & (F.col("kind") == "class"), "name").alias("classes"), names(F.col("fact") == "import", "module").alias("imports"))


@query("prj_03_calls_by_function", _rows("file, caller, callees", ("b.py", "Greeter.run", "greet"), ("flow.py", "main", "a.farewell,map,total"), ("flow.py", "total", "o.getcwd")))
def prj_03(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark).filter("fact = 'call'").groupBy("file", F.col("function").alias("caller")).agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("callees"))


@query("prj_04_by_class", _rows("name", ("run",), ("stop",)))
def prj_04(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark).filter("fact = 'symbol' and kind = 'method' and module = 'Greeter'").select("name")


@query("prj_06_selection", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') UNION SELECT doc_id FROM documents WHERE lang = 'fr' EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def prj_06(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    add = d.filter("source in ('src1', 'src2')").select("doc_id").union(d.filter("lang = 'fr'").select("doc_id")).distinct()
    return add.join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_anti")


@query("prj_08_durable", _rows("path, durable, pack", ("x/node_modules/@s/p/i.js", True, "@s/p"), ("x/node_modules/p/i.js", True, "p"), ("lib/site-packages/q/a.py", True, "q"), ("src/a.py", False, None)))
def prj_08(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, "path string", ("x/node_modules/@s/p/i.js",), ("x/node_modules/p/i.js",), ("lib/site-packages/q/a.py",), ("src/a.py",))
    return d.select("path", C.durable(F.col("path")).alias("durable"), C.package_key(F.col("path")).alias("pack"))


@query("prj_09_library_symbols", _rows("id, lib", ("a.py:os.path.join", True), ("a.py:flask.run", True), ("a.py:test_x", True), ("a.py:osprey", False)))
def prj_09(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, "id string", ("a.py:os.path.join",), ("a.py:flask.run",), ("a.py:test_x",), ("a.py:osprey",))
    return d.withColumn("lib", C.library_symbol(F.col("id")))


@query("prj_10_self_documenting", _rows("n, ok", (1, True), (2, False), (3, False), (4, False)))
def prj_10(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, "n int, sig string, code string", (1, "def f(a: int, b: Dict[str, int] = {}) -> int", "return a"), (2, "def f(a) -> int", "return a"), (3, "def f(a: int)", "return a"), (4, "def f(a: int) -> int", "print(a)"))
    return d.select("n", C.self_documenting(F.col("sig"), F.col("code")).alias("ok"))


def zoom(symbols: DataFrame, level: int) -> DataFrame:
    """L0 the id, L1 with its signature, L2 with lines of control flow, L4 with the whole body."""
    body = F.col("code")
    flow = F.array_join(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s*(?:if|for|while|try|except|else|elif|return|with|match|case)\b")), "\n")
    parts = [F.col("id"), F.col("signature"), flow, body]
    return symbols.select("id", F.concat_ws("\n", *{0: parts[:1], 1: parts[:2], 2: parts[:3], 3: parts[:3], 4: [parts[0], parts[3]]}[level]).alias("text"))


@query("prj_11_zoom", _rows("id, text", ("f", "f\ndef f(a)\n    if a:\n        return 1")))
def prj_11(spark: SparkSession, sf: str) -> DataFrame:
    return zoom(_frame(spark, "id string, signature string, code string", ("f", "def f(a)", "def f(a):\n    x = 1\n    if a:\n        return 1")), 2)


@query("prj_12_strip", _rows("text", ("def f():\n    \n    x = 1  # TODO: y\n    s = '# no'\n    return x \n",)))
def prj_12(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.parse.strip import stripped

    d = _frame(spark, "t string", ('def f():\n    """doc"""\n    x = 1  # TODO: y\n    s = \'# no\'\n    return x # gone\n',))
    return d.select(stripped("t").alias("text"))


@query("prj_13_entry_points", _rows("entries", ("load file,ChangeImpact,map_hunks,run_it",)))
def prj_13(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, "task string", ("Fix `load file` in ChangeImpact and map_hunks, then run_it, ChangeImpact again",))
    return d.select(F.array_join(C.entry_points(F.col("task")), ",").alias("entries"))


@query("prj_16_guards", _rows("pos, found", (1, False), (2, True), (3, False), (4, False)))
def prj_16(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, "pos int, line string", (1, "seen = []"), (2, "if x in seen:"), (3, "    out.append(x)"), (4, "if y in seen:"))
    w = W.orderBy("pos").rowsBetween(1, 3)
    return d.select("pos", C.suspicious_guard(F.col("line"), F.collect_list("line").over(w)).alias("found"))


@query("prj_17_by_ids", "SELECT item_id, length(text) AS n FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels)")
def prj_17(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    return table(spark, sf, "benchmark").join(ids, "item_id", "left_semi").select("item_id", F.length("text").cast("long").alias("n"))


@query("prj_20_graph_counts", _rows("function, blocks, edges, control, data", ("total", 9, 10, 3, 8)))
def prj_20(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda f: F.count_if(F.col("fact") == f).cast("int")
    return facts(spark).filter("function = 'total'").groupBy("function").agg(n("cfg_block").alias("blocks"), n("cfg_edge").alias("edges"), n("control_edge").alias("control"), n("dfg_edge").alias("data"))


@query("prj_21_edit_boundary", f"WITH {LINES}, h AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM v_lines WHERE regexp_matches(line, '[0-9]') GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM v_lines GROUP BY 1) SELECT doc_id, a, b, least(3, a - 1) AS before, least(3, n - b) AS after FROM h JOIN n USING (doc_id)")
def prj_21(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.when(F.rlike("line", F.lit("[0-9]")), F.col("pos"))
    g = lines(spark, sf).groupBy("doc_id").agg(F.min(hit).alias("a"), F.max(hit).alias("b"), F.count("*").alias("n")).filter("a is not null")
    return g.select("doc_id", "a", "b", F.least(F.lit(3), F.col("a") - 1).alias("before"), F.least(F.lit(3), F.col("n") - F.col("b")).alias("after"))


@query("prj_22_context_width", _rows("n, width", (1, 6), (2, 8), (3, 2), (4, 8), (5, 6)))
def prj_22(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, "n int, ls array<string>", (1, []), (2, ["", " "]), (3, ["a = 1", "b = 2"]), (4, ["a", "", "", "b", ""]), (5, ["abc", "", "def", "", "ghi", "jkl"]))
    return d.select("n", C.context_width(F.col("ls")).alias("width"))


@query("prj_24_exports", _rows("name", ("greet",), ("farewell",)))
def prj_24(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark).filter("fact = 'symbol' and module is null and file = 'a.py'").select("name")


@query("jon_09_line_to_node", _rows("line, kind", (5, "body"), (6, "loop"), (7, "branch"), (8, "body"), (9, "body"), (10, "body"), (11, "return")))
def jon_09(spark: SparkSession, sf: str) -> DataFrame:
    b = facts(spark).filter("fact = 'cfg_block' and function = 'total' and kind not in ('entry', 'exit')")
    return b.select(F.explode(F.sequence("a", "b")).alias("line"), "kind", "n").groupBy("line").agg(F.max_by("kind", "n").alias("kind"))


@query("jon_15_cross_references", _rows("file, name", ("b.py", "greet"), ("flow.py", "farewell")))
def jon_15(spark: SparkSession, sf: str) -> DataFrame:
    """Where symbols of an edited module are used: files whose imports name it, joined to calls of its names."""
    f = facts(spark)
    users = f.filter("fact = 'import' and (module = 'a' or module like 'a.%')").select("file").distinct()
    edited = f.filter("fact = 'symbol' and file = 'a.py'").select("name")
    return f.filter("fact = 'call'").select("file", F.element_at(F.split("target", r"\."), -1).alias("name")).join(users, "file").join(edited, "name").select("file", "name").distinct()


@query("jon_25_expanded_hits", _rows("hit, near", ("a.py:greet", "b.py:Greeter.run"), ("flow.py:main", "a.py:farewell,flow.py:total")))
def jon_25(spark: SparkSession, sf: str) -> DataFrame:
    e = call_graph(facts(spark)).select(F.concat_ws(":", "src_file", "src_func").alias("s"), F.concat_ws(":", "dst_file", "dst_func").alias("d"))
    both = e.union(e.select("d", "s")).toDF("hit", "near")
    hits = _frame(spark, "hit string", ("a.py:greet",), ("flow.py:main",))
    return both.join(hits, "hit").groupBy("hit").agg(F.array_join(F.array_sort(F.collect_set("near")), ",").alias("near"))


@query("agg_12_type_pruning", "WITH g AS (SELECT p_type AS callee, p_brand || '/' || p_size AS pattern, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL) SELECT callee, pattern, n FROM g QUALIFY row_number() OVER (PARTITION BY callee ORDER BY n DESC, first) <= 5")
def agg_12(spark: SparkSession, sf: str) -> DataFrame:
    """Of each callee the five commonest patterns of callers, the earliest first where they tie."""
    g = table(spark, sf, "part").groupBy(F.col("p_type").alias("callee"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("pattern")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    r = F.row_number().over(W.partitionBy("callee").orderBy(F.desc("n"), "first"))
    return g.withColumn("r", r).filter("r <= 5").select("callee", "pattern", "n")


@query("agg_30_dependency_tokens", "WITH f AS (SELECT o_orderkey AS fixture, list_distinct(list(l_partkey)) AS deps FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT l_orderkey AS fixture, CAST(sum(greatest(1, floor(length(p_name) / 4))) AS BIGINT) AS tokens FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY 1")
def agg_30(spark: SparkSession, sf: str) -> DataFrame:
    deps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fixture"), F.col("l_partkey").alias("p_partkey")).distinct()
    return deps.join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").groupBy("fixture").agg(F.sum(T.token_estimate(F.col("p_name"))).alias("tokens"))


@query("win_03_clamp", "SELECT p_brand AS file, p_partkey AS id, greatest(10, p_size - 3) AS a, least(40, p_size + 3) AS b FROM part WHERE p_size BETWEEN 8 AND 42")
def win_03(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter("p_size between 8 and 42")
    return p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("id"), F.greatest(F.lit(10), F.col("p_size") - 3).alias("a"), F.least(F.lit(40), F.col("p_size") + 3).alias("b"))


@query("win_09_rank", "SELECT s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier")
def win_09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).cast("long").alias("rank"))


@query("win_14_quota", "SELECT conv_id, turn, CAST(greatest(0, least(length(text), 3000 - (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text)))) AS BIGINT) AS quota FROM conversations")
def win_14(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text").cast("long")
    before = F.sum(n).over(W.partitionBy("conv_id").orderBy("turn")) - n
    return table(spark, sf, "conversations").select("conv_id", "turn", F.greatest(F.lit(0), F.least(n, 3000 - before)).alias("quota"))


@query("top_10_clamp", "SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 50")
def top_10(spark: SparkSession, sf: str) -> DataFrame:
    """Asked for a thousand hits, a search gives its most: fifty."""
    return table(spark, sf, "embeddings").orderBy("vec_id").limit(max(1, min(1000, 50))).select("vec_id")


@query("set_01_three_way", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7")
def set_01(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")).unionAll(o.filter("o_totalprice > 300000").select("o_orderkey")).unionAll(table(spark, sf, "lineitem").filter("l_linenumber = 7").select("l_orderkey"))


@query("set_03_sections", "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY ALL")
def set_03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))


@query("set_04_partitions", "SELECT o_orderkey AS edge, o_orderstatus = 'F' AS durable FROM orders")
def set_04(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("edge"), F.lit(True).alias("durable")).unionAll(o.filter("o_orderstatus <> 'F'").select("o_orderkey", F.lit(False)))


@query("inc_04_delta_context", "WITH n AS (SELECT doc_id, sha256(text) AS etag, source FROM documents), c AS (SELECT doc_id, etag FROM n WHERE source NOT IN ('src3', 'src4')) SELECT n.doc_id, CASE WHEN c.etag IS NULL THEN 'send' ELSE 'signature' END AS form FROM n LEFT JOIN c ON c.doc_id = n.doc_id")
def inc_04(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("etag"), "source")
    s = S.delta(d.select("id", "etag"), d.filter("source not in ('src3', 'src4')").select("id", "etag"))
    return s.select(F.col("id").alias("doc_id"), F.when(F.col("state") == "unchanged", "signature").otherwise("send").alias("form"))


@query("inc_08_dirty", "SELECT source, count(DISTINCT lang) AS dirty FROM documents GROUP BY source")
def inc_08(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source", "lang").distinct().groupBy("source").agg(F.count("*").alias("dirty"))


@query("inc_12_index_plan", "WITH s AS (SELECT count(*) FILTER (source = 'src1') AS gone, count(*) FILTER (source = 'src2') AS fresh, count(*) AS n FROM documents) SELECT gone, fresh, n, gone >= 0.2 * n OR fresh >= 50 AS rebuild FROM s")
def inc_12(spark: SparkSession, sf: str) -> DataFrame:
    """An index is rebuilt at a fifth of deletions or fifty updates, else only what changed is embedded."""
    s = table(spark, sf, "documents").agg(F.count_if(F.col("source") == "src1").alias("gone"), F.count_if(F.col("source") == "src2").alias("fresh"), F.count("*").alias("n"))
    return s.withColumn("rebuild", (F.col("gone") >= 0.2 * F.col("n")) | (F.col("fresh") >= 50))


@F.pandas_udf(StringType())
def symbol_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff of two bodies, null where they are equal or the diff isn't worth it (over five hunks, or 70 % of the size)."""

    def one(a: str, b: str) -> str | None:
        d = list(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="", n=1))[2:]
        text = "\n".join(d)
        return text if d and sum(x.startswith("@@") for x in d) <= 5 and len(text) < 0.7 * len(b) else None

    return pd.Series([one(a or "", b or "") for a, b in zip(old, new, strict=True)])


@query("inc_13_symbol_diff", _rows("n, hunks", (1, 1), (2, None)))
def inc_13(spark: SparkSession, sf: str) -> DataFrame:
    body = "\n".join(f"line number {i}" for i in range(40))
    d = _frame(spark, "n int, a string, b string", (1, body, body.replace("number 7\n", "number seven\n")), (2, body, body))
    return d.select("n", symbol_diff("a", "b").alias("d")).select("n", F.when(F.col("d").isNotNull(), F.regexp_count("d", F.lit("(?m)^@@"))).alias("hunks"))


@query("inc_15_session_close", "SELECT json_extract_string(props, '$.k') AS symbol_id, count(*) AS deliveries, count(*) FILTER (event_type = 'purchase') AS uses FROM events WHERE user_id = 7 GROUP BY 1")
def inc_15(spark: SparkSession, sf: str) -> DataFrame:
    own = deliveries(spark, sf).filter("session_id = 7")
    return S.popularity(own, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("symbol_id", "deliveries", "uses")


@query("inc_16_open_cells", "SELECT DISTINCT c_custkey AS task FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def inc_16(spark: SparkSession, sf: str) -> DataFrame:
    """What a resumed run still has to do."""
    done = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("task"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("task")).join(done, "task", "left_anti").distinct()


@query("inc_17_workbench", "SELECT o_custkey AS hypothesis, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > count(*) FILTER (o_orderstatus = 'O') THEN 'supported' WHEN count(*) FILTER (o_orderstatus = 'O') > count(*) FILTER (o_orderstatus = 'F') THEN 'refuted' ELSE 'open' END AS status FROM orders GROUP BY 1")
def inc_17(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("hypothesis")).agg(n("F").alias("f"), n("O").alias("o"))
    return a.select("hypothesis", F.when(F.col("f") > F.col("o"), "supported").when(F.col("o") > F.col("f"), "refuted").otherwise("open").alias("status"))


@query("inc_19_blob_touch", "SELECT sha256(text) AS hash, max(doc_id) AS last_accessed, count(*) AS refs FROM documents GROUP BY 1")
def inc_19(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id").groupBy("hash").agg(F.max("doc_id").alias("last_accessed"), F.count("*").alias("refs"))


@query("gra_14_plan_advice", "SELECT o_orderpriority AS plan, CASE WHEN count(*) FILTER (o_orderstatus = 'F') >= 0.6 * count(*) THEN 'stop' WHEN count(*) FILTER (o_orderstatus = 'P') > 0.02 * count(*) THEN 'replan' ELSE 'go on' END AS advice FROM orders GROUP BY 1")
def gra_14(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    a = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("plan")).agg(F.count("*").alias("n"), n("F").alias("f"), n("P").alias("p"))
    return a.select("plan", F.when(F.col("f") >= 0.6 * F.col("n"), "stop").when(F.col("p") > 0.02 * F.col("n"), "replan").otherwise("go on").alias("advice"))


@query("gra_17_coherence", _rows("name, kind, users", ("farewell", "removed", "flow.py"), ("greet", "changed", "b.py")))
def gra_17(spark: SparkSession, sf: str) -> DataFrame:
    """Edited signatures of a module with the files that use them."""
    old = Y.symbol_ranges(facts(spark)).filter("file = 'a.py'").select("name", "signature")
    new = _frame(spark, "name string, signature string", ("greet", "def greet(name: str, loud: bool) -> str"))
    return R.edited_signatures(old, new).join(jon_15(spark, sf), "name").groupBy("name", "kind").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("users"))


@query("pck_05_compression", _rows("text", ("a = 1\n... [2 lines]\nhit",)))
def pck_05(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that the knapsack leaves out become a mark with their number of lines."""
    b = _frame(spark, "fn string, block int, cost int, score double, must boolean, body string, n int", ("f", 0, 3, 5.0, False, "a = 1", 1), ("f", 1, 90, 1.0, False, "b\nc", 2), ("f", 2, 2, 0.0, True, "hit", 1))
    kept = P.knapsack(b, "fn", 20)
    piece = F.when(F.col("kept"), F.col("body")).otherwise(F.concat(F.lit("... ["), F.col("n").cast("string"), F.lit(" lines]")))
    return b.join(kept, ["fn", "block"]).groupBy("fn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", piece.alias("t")))), lambda x: x.t), "\n").alias("text")).select("text")


@query("pck_09_context_pack", _rows("id, choice", ("flow.py:main", "full"), ("a.py:farewell", "full"), ("flow.py:total", "sig")))
def pck_09(spark: SparkSession, sf: str) -> DataFrame:
    """Entry -> call graph -> candidates by depth -> greedy pack."""
    from tessera.operators import graph as G

    f = facts(spark)
    e = call_graph(f).select(F.concat_ws(":", "src_file", "src_func").alias("src"), F.concat_ws(":", "dst_file", "dst_func").alias("dst"))
    near = G.reach(e, _frame(spark, "node string", ("flow.py:main",)), 2)
    s = Y.symbol_ranges(f).select(F.col("symbol_id").alias("node"), ((F.col("end_line") - F.col("start_line") + 1) * 5).cast("double").alias("full"), F.lit(5.0).alias("sig"))
    c = near.join(s, "node").select(F.lit("p").alias("pack"), "depth", "node", F.col("node").alias("sid"), "full", "sig")
    return P.greedy(c, "pack", ["depth", "node"], "sid", "full", "sig", F.lit(40)).select("id", "choice")


@query("src_51_embed", r"""WITH t AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+'))) AS h FROM documents),
 s AS (SELECT doc_id, CAST('0x' || substring(h, 1, 4) AS INTEGER) % 64 AS slot, sum(CASE WHEN substring(h, 5, 1) < '8' THEN 1 ELSE -1 END) AS v FROM t GROUP BY ALL)
 SELECT doc_id, CAST(slot AS BIGINT) AS slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s QUALIFY v <> 0""")
def src_51(spark: SparkSession, sf: str) -> DataFrame:
    """A hashing embedder: signed token hashes summed in 64 slots, normalised; the slots that aren't zero."""
    from tessera.operators.embed import hashed_vectors

    v = hashed_vectors(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.posexplode("embedding").alias("slot", "value"))
    return v.filter("value <> 0").select("doc_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


@query("src_55_lookup", _rows("symbol_id, start_line", ("b.py:Greeter.run", 4)))
def src_55(spark: SparkSession, sf: str) -> DataFrame:
    return Y.symbol_ranges(facts(spark)).filter("symbol_id = 'b.py:Greeter.run'").select("symbol_id", "start_line")


@query("src_41_structural", _rows("path, line, x", ("flow.py", 10, ""), ("flow.py", 14, "[1], 2"), ("flow.py", 15, "t"), ("flow.py", 16, "total, [t]"), ("b.py", 5, "'world'")))
def src_41(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.parse.structural import matches

    return matches(project(spark), "$F($$$X)").select("path", "line", F.element_at("captures", "X").alias("x"))


assert PROJECT
