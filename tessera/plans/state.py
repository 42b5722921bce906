"""State queries: events as deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import state as S
from tessera.registry import query
from tessera.standins import DELIVERIES, deliveries, table

_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def _now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


_POP = f"""{DELIVERIES}, a AS (SELECT symbol_id, count(*) AS deliveries, count(*) FILTER (used) AS uses, max(seen) AS last_at FROM v_deliveries GROUP BY symbol_id),
 pop AS (SELECT symbol_id, deliveries, uses, last_at, round(0.6 * uses / deliveries + 0.3 / (1 + greatest(0.0, (floor(epoch({_NOW})) - floor(epoch(last_at))) / 86400.0)) + 0.1 * least(deliveries / 50.0, 1.0), 8) AS score FROM a)"""


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("agg_01_popularity", f"WITH {_POP} SELECT symbol_id, deliveries, uses, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at, score FROM pop")
def agg_01(spark: SparkSession, sf: str) -> DataFrame:
    return S.popularity(deliveries(spark, sf), _now()).select("symbol_id", "deliveries", "uses", _text("last_at"), "score")


@query("agg_01_merge", f"WITH {_POP} SELECT symbol_id, deliveries, uses, score FROM pop")
def agg_01_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two halves of the log, aggregated apart and merged, give what the whole log gives."""
    d = deliveries(spark, sf)
    halves = [S.popularity(d.filter(x), _now()) for x in ("use_type in ('view', 'click')", "use_type not in ('view', 'click')")]
    return S.merge_popularity(*halves, _now()).select("symbol_id", "deliveries", "uses", "score")


@query("agg_02_usage", f"""WITH {DELIVERIES}, b AS (SELECT symbol_id, use_type, count(*) AS n FROM v_deliveries GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY n DESC, use_type) AS r FROM b)
 SELECT symbol_id, CAST(sum(n) AS BIGINT) AS n, string_agg(use_type || ':' || n, ',' ORDER BY r) FILTER (r <= 3) AS top_types FROM r GROUP BY symbol_id""")
def agg_02(spark: SparkSession, sf: str) -> DataFrame:
    return S.usage(deliveries(spark, sf))


_PAIRS = f"{DELIVERIES}, o AS (SELECT DISTINCT session_id, symbol_id FROM v_deliveries), pairs AS (SELECT x.symbol_id AS a, y.symbol_id AS b, count(*) AS n FROM o x JOIN o y USING (session_id) WHERE x.symbol_id < y.symbol_id GROUP BY ALL)"


@query("agg_03_co_occurrence", f"WITH {_PAIRS} SELECT * FROM pairs")
def agg_03(spark: SparkSession, sf: str) -> DataFrame:
    return S.co_occurrence(deliveries(spark, sf))


@query("agg_04_partners", f"WITH {_PAIRS} SELECT CASE WHEN a = '7' THEN b ELSE a END AS partner, n FROM pairs WHERE a = '7' OR b = '7' ORDER BY n DESC, partner LIMIT 10")
def agg_04(spark: SparkSession, sf: str) -> DataFrame:
    return S.partners(S.co_occurrence(deliveries(spark, sf)), "7")


@query("agg_05_sessions", f"WITH {DELIVERIES} SELECT session_id, count(*) AS total, count(*) FILTER (used) AS used, round(count(*) FILTER (used) / count(*), 8) AS rate FROM v_deliveries GROUP BY session_id")
def agg_05(spark: SparkSession, sf: str) -> DataFrame:
    return S.session_summary(deliveries(spark, sf))


@query("agg_06_delivery_stats", f"WITH {DELIVERIES} SELECT count(*) AS n, CAST(coalesce(sum(CASE WHEN used THEN 1 ELSE 0 END), 0) AS BIGINT) AS used, count(DISTINCT session_id) AS sessions FROM v_deliveries")
def agg_06(spark: SparkSession, sf: str) -> DataFrame:
    return deliveries(spark, sf).agg(F.count("*").alias("n"), F.coalesce(F.count_if("used"), F.lit(0)).alias("used"), F.countDistinct("session_id").alias("sessions"))


@query("agg_07_store_stats", "SELECT count(*) AS objects, CAST(sum(strlen(text)) AS BIGINT) AS stored, CAST(sum(n_chars) AS BIGINT) AS size FROM documents")
def agg_07(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("objects"), F.sum(F.octet_length("text")).alias("stored"), F.sum("n_chars").alias("size"))


_ATT = f"""{_POP}, {_PAIRS[len(DELIVERIES) + 2 :]}, e AS (SELECT symbol_id, sum(n) AS together FROM (SELECT a AS symbol_id, n FROM pairs UNION ALL SELECT b, n FROM pairs) GROUP BY symbol_id),
 att AS (SELECT symbol_id, round(0.7 * least(1.0, 0.5 + 0.3 * uses / deliveries + CASE WHEN (floor(epoch({_NOW})) - floor(epoch(last_at))) / 86400.0 <= 7 THEN 0.1 ELSE 0.0 END + least(0.1, coalesce(together, 0) / 1000.0)) + 0.3 * score, 9) AS score FROM pop LEFT JOIN e USING (symbol_id))"""


def _attention(spark: SparkSession, sf: str) -> DataFrame:
    d = deliveries(spark, sf)
    return S.attention(d, S.co_occurrence(d), _now())


@query("agg_08_attention", f"WITH {_ATT} SELECT * FROM att")
def agg_08(spark: SparkSession, sf: str) -> DataFrame:
    return _attention(spark, sf)


@query("top_02_rerank", f"WITH {_ATT} SELECT p_partkey AS id, round(0.7 * (p_size / 50.0) + 0.3 * coalesce(score, 0.5), 10) AS blend FROM part LEFT JOIN att ON symbol_id = CAST(p_partkey AS VARCHAR) ORDER BY blend DESC, id LIMIT 200")
def top_02(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("symbol_id"), (F.col("p_size") / 50.0).alias("relevance"))
    return S.rerank(c, _attention(spark, sf)).select("id", "blend").orderBy(F.desc("blend"), "id").limit(200)


@query("top_03_prune", f"WITH {_ATT}, r AS (SELECT *, row_number() OVER (PARTITION BY score >= 0.66 ORDER BY score DESC, symbol_id) AS r FROM att) SELECT symbol_id, score, CASE WHEN score < 0.66 THEN 'below_min' WHEN r > 20 THEN 'over_budget' ELSE 'kept' END AS decision FROM r")
def top_03(spark: SparkSession, sf: str) -> DataFrame:
    return S.prune(_attention(spark, sf), 20, 0.66)


@query("top_04_hotspots", f"WITH {_POP} SELECT symbol_id, score FROM pop WHERE last_at >= TIMESTAMP '2024-01-28 00:00:00' ORDER BY score DESC, symbol_id LIMIT 15")
def top_04(spark: SparkSession, sf: str) -> DataFrame:
    return S.hotspots(S.popularity(deliveries(spark, sf), _now()), 15, F.lit("2024-01-28 00:00:00").cast("timestamp")).select("symbol_id", "score")


@query("top_05_recent", f"WITH {DELIVERIES} SELECT seq, session_id, symbol_id FROM v_deliveries ORDER BY seen DESC, seq DESC LIMIT 50")
def top_05(spark: SparkSession, sf: str) -> DataFrame:
    return deliveries(spark, sf).orderBy(F.desc("at"), F.desc("seq")).limit(50).select("seq", "session_id", "symbol_id")


@query("top_06_evict", """WITH o AS (SELECT sha256(doc_id::VARCHAR) AS hash, n_chars AS size, doc_id AS last_accessed FROM documents), t AS (SELECT sum(size) AS total FROM o),
 f AS (SELECT * FROM o WHERE hash NOT IN (SELECT hash FROM o ORDER BY last_accessed DESC, hash DESC LIMIT 50)),
 b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY last_accessed, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f) SELECT hash, size FROM b, t WHERE total - before > 1000000""")
def top_06(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("hash"), F.col("n_chars").alias("size"), F.col("doc_id").alias("last_accessed"))
    return S.evict(o, 1_000_000, 50)


@query("win_10_last_per_task", "SELECT o_custkey AS task, o_orderkey AS pos, o_totalprice AS tokens FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def win_10(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("tokens"))
    return S.latest(o, ["task"], "pos").select("task", "pos", "tokens")


@query("win_11_latest_delivery", f"WITH {DELIVERIES} SELECT session_id, symbol_id, seq, use_type FROM v_deliveries QUALIFY row_number() OVER (PARTITION BY session_id, symbol_id ORDER BY seq DESC) = 1")
def win_11(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest(deliveries(spark, sf), ["session_id", "symbol_id"], "seq").select("session_id", "symbol_id", "seq", "use_type")


@query("win_12_latest_snapshot", "SELECT source, max(doc_id) AS doc_id, sha256(arg_max(text, doc_id)) AS snapshot FROM documents GROUP BY source")
def win_12(spark: SparkSession, sf: str) -> DataFrame:
    """The hash goes through the aggregate, not the text."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.max_by("h", "doc_id").alias("snapshot"))


@query("inc_01_delivery_counters", f"WITH {DELIVERIES} SELECT symbol_id, use_type, count(*) AS n FROM v_deliveries GROUP BY ALL")
def inc_01(spark: SparkSession, sf: str) -> DataFrame:
    return deliveries(spark, sf).groupBy("symbol_id", "use_type").agg(F.count("*").alias("n"))


@query("inc_02_sessions", f"WITH {DELIVERIES} SELECT session_id, count(DISTINCT symbol_id) AS symbols, strftime(min(seen), '%Y-%m-%d %H:%M:%S') AS opened, strftime(max(seen), '%Y-%m-%d %H:%M:%S') AS touched FROM v_deliveries GROUP BY session_id")
def inc_02(spark: SparkSession, sf: str) -> DataFrame:
    s = deliveries(spark, sf).groupBy("session_id").agg(F.countDistinct("symbol_id").alias("symbols"), F.min("at").alias("opened"), F.max("at").alias("touched"))
    return s.select("session_id", "symbols", _text("opened"), _text("touched"))


@query("inc_03_expired", f"WITH {DELIVERIES} SELECT session_id, count(*) AS n FROM v_deliveries GROUP BY session_id HAVING (floor(epoch({_NOW})) - floor(epoch(max(seen)))) / 86400.0 > 2.5")
def inc_03(spark: SparkSession, sf: str) -> DataFrame:
    return S.expired(deliveries(spark, sf), _now(), 2.5).select("session_id", "n")


@query("inc_03_retained", f"WITH {DELIVERIES} SELECT seq FROM v_deliveries WHERE session_id NOT IN (SELECT session_id FROM v_deliveries GROUP BY session_id HAVING (floor(epoch({_NOW})) - floor(epoch(max(seen)))) / 86400.0 > 2.5)")
def inc_03_retained(spark: SparkSession, sf: str) -> DataFrame:
    d = deliveries(spark, sf)
    return d.join(S.expired(d, _now(), 2.5), "session_id", "left_anti").select("seq")


_OLD = "o AS (SELECT doc_id AS id, CASE WHEN lang = 'en' THEN sha256(text) ELSE sha256(text || 'x') END AS etag FROM documents WHERE source <> 'src1'), c AS (SELECT doc_id AS id, sha256(text) AS etag FROM documents WHERE source <> 'src2')"


def _etags(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    current = d.filter("source <> 'src2'").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("etag"))
    old = d.filter("source <> 'src1'").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit("x")), 256)).alias("etag"))
    return current, old


@query("jon_12_delta", f"WITH {_OLD} SELECT c.id, CASE WHEN o.etag IS NULL THEN 'new' WHEN o.etag = c.etag THEN 'unchanged' ELSE 'changed' END AS state FROM c LEFT JOIN o USING (id)")
def jon_12(spark: SparkSession, sf: str) -> DataFrame:
    return S.delta(*_etags(spark, sf))


@query("jon_13_index_diff", f"WITH {_OLD} SELECT id, CASE WHEN o.etag IS NULL THEN 'new' WHEN c.etag IS NULL THEN 'deleted' WHEN o.etag = c.etag THEN 'unchanged' ELSE 'changed' END AS state FROM c FULL JOIN o USING (id)")
def jon_13(spark: SparkSession, sf: str) -> DataFrame:
    return S.index_diff(*_etags(spark, sf))


@query("inc_07_changed_files", f"WITH {_OLD} SELECT c.id FROM c JOIN o USING (id) WHERE c.etag <> o.etag")
def inc_07(spark: SparkSession, sf: str) -> DataFrame:
    return S.delta(*_etags(spark, sf)).filter("state = 'changed'").select("id")


@query("inc_05_content_dedup", "SELECT sha256(text) AS sha, min(doc_id) AS parsed, count(*) AS files FROM documents GROUP BY 1")
def inc_05(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct content is parsed once, under its first file."""
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha")).groupBy("sha").agg(F.min("doc_id").alias("parsed"), F.count("*").alias("files"))


@query("inc_06_graph_patch", """WITH e AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 50 AS dst, 'old' AS origin FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')), n AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 60 AS dst, 'new' AS origin FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) SELECT * FROM e UNION ALL SELECT * FROM n""")
def inc_06(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of edited files go; their new ones come."""
    edited = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("src"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), "o_orderkey")
    old = o.join(edited, "src", "left_anti").select("src", (F.col("o_orderkey") % 50).alias("dst"), F.lit("old").alias("origin")).distinct()
    new = o.join(edited, "src", "left_semi").select("src", (F.col("o_orderkey") % 60).alias("dst"), F.lit("new").alias("origin")).distinct()
    return old.unionByName(new)


@query("top_09_timeline", """WITH a AS (SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS id, ts AS seen FROM events ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 40), b AS (SELECT 'order', CAST(o_orderkey AS VARCHAR), o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC LIMIT 40), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
 SELECT kind, id, strftime(seen, '%Y-%m-%d %H:%M:%S') AS seen FROM u ORDER BY u.seen DESC, kind, id LIMIT 60""")
def top_09(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("at"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("at"))
    return S.timeline({"event": e, "order": o}, 40, 60).select("kind", "id", _text("at").alias("seen"))
