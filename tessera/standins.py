"""The driver's tables in the roles of the engine's: lines, edges, symbols, deliveries, units, outcomes; and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import code_tokens
from tessera.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) for work on whole texts, over all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos from 1, line, terms)."""
    d = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "line", code_tokens(F.col("line")).alias("terms"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst): customers as functions, orders as calls."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.expr("o_custkey div 2 + o_orderkey % 7").alias("dst")).distinct()


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, symbol_id, name, start_line, end_line): parts of a brand as the symbols of a file, ten lines apart."""
    w = W.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), (10 * F.row_number().over(w)).cast("long").alias("start_line"))
    nxt = F.lead("start_line").over(W.partitionBy("file").orderBy("start_line"))
    return p.withColumn("end_line", F.greatest("start_line", F.coalesce(nxt - 1, F.col("start_line") + 9)))


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hunk, file, h_start, h_end): events as changes to lines of a brand's file."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("no", (F.row_number().over(W.orderBy("p_brand")) - 1).cast("long"))
    size = brands.agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(size)).select(F.col("event_id").alias("hunk"), (F.col("event_id") % F.col("n")).alias("no"), (F.col("event_id") * 7 % 800).alias("h_start"))
    return e.join(F.broadcast(brands), "no").select("hunk", F.col("p_brand").alias("file"), "h_start", (F.col("h_start") + 5).alias("h_end"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, session_id, symbol_id, at, use_type, used): events as deliveries of symbols to users' sessions."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").alias("symbol_id"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("use_type"), (F.col("event_type") == "purchase").alias("used"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, variant, success, tokens, pos): orders as results of runs."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("variant"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_totalprice").alias("tokens"), F.col("o_orderkey").alias("pos"))


#: The same in DuckDB SQL, as common table expressions to put after WITH.
TOKENS = r"regexp_extract_all(lower(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')"
LINES = f"v_lines AS (SELECT doc_id, i AS pos, ls[i] AS line, {TOKENS.format('ls[i]')} AS terms FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d, range(1, len(ls) + 1) r(i))"
EDGES = "v_edges AS (SELECT DISTINCT o_custkey AS src, o_custkey // 2 + o_orderkey % 7 AS dst FROM orders)"
SYMBOLS = """v_starts AS (SELECT p_brand AS file, p_partkey AS symbol_id, p_name AS name, CAST(10 * row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS start_line FROM part),
v_symbols AS (SELECT *, greatest(start_line, coalesce(lead(start_line) OVER (PARTITION BY file ORDER BY start_line) - 1, start_line + 9)) AS end_line FROM v_starts)"""
HUNKS = """v_brands AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS no, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)),
v_hunks AS (SELECT event_id AS hunk, p_brand AS file, event_id * 7 % 800 AS h_start, event_id * 7 % 800 + 5 AS h_end FROM events JOIN v_brands ON event_id % n = no)"""
DELIVERIES = "v_deliveries AS (SELECT event_id AS seq, user_id AS session_id, json_extract_string(props, '$.k') AS symbol_id, ts AS seen, event_type AS use_type, event_type = 'purchase' AS used FROM events)"
OUTCOMES = "v_outcomes AS (SELECT o_custkey AS task, o_orderpriority AS variant, o_orderstatus = 'F' AS success, o_totalprice AS tokens, o_orderkey AS pos FROM orders)"
