"""Record and trace queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import formats as O
from tessera.plans.code import _rows, facts
from tessera.registry import query
from tessera.sources import files as W
from tessera.sources import records as R
from tessera.standins import table


@query("src_45_turns", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered, CAST(sum(greatest(1, floor(length(text) / 4))) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def src_45(spark: SparkSession, sf: str) -> DataFrame:
    n = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.count_if(F.col("role") == "assistant").alias("answered"), F.sum(n).alias("tokens"))


_TRACE = [
    '{"type":"thread.started","thread_id":"t"}',
    '{"type":"item.completed","item":{"type":"command_execution","command":"cat a.py","aggregated_output":"0123456789","exit_code":0}}',
    '{"type":"item.completed","item":{"type":"command_execution","command":"ls","aggregated_output":"abc","exit_code":0}}',
    "not json",
    '{"type":"context.compacted"}',
    '{"type":"turn.completed","usage":{"input_tokens":1000,"cached_input_tokens":400,"output_tokens":500}}',
]


@query("src_45_trace", "SELECT trace, COLUMNS(lambda c: c <> 'trace')::BIGINT FROM (" + _rows("trace, total_tokens, cached_tokens, tool_calls, output_bytes, raw_reads, compactions, malformed", ("t", 1500, 400, 2, 13, 1, 1, 1)) + ")")
def src_45_trace(spark: SparkSession, sf: str) -> DataFrame:
    return R.trace_metrics(spark.createDataFrame([("t", x) for x in _TRACE], "trace string, line string"))


@query("src_43_longbench", _rows("instance_id, prompt, answer, split", ("code:lb-1", "q", "a", "test"), ("code:lb-2", "r", None, "dev")))
def src_43(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([("code", "lb-1", "q", "a", ""), ("code", "lb-2", "r", " ", "dev")], "dataset string, id string, input string, output string, split string")
    return R.normalise(d).drop("metadata")


@query("src_43_benchmark", "SELECT CAST(item_id AS VARCHAR) AS instance_id, text AS prompt FROM benchmark WHERE trim(text) <> ''")
def src_43_bench(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    d = R.normalise(b).select("instance_id", "prompt").filter("prompt is not null")
    return d


_PATHS = ["src/a.py", "src/gen/b.py", "build/c.py", "keep/build.py", "logs/x.log", "logs/keep.log", "deep/logs/y.log", "node_modules/m/i.js"]


@query("src_04_ignored", _rows("path", ("src/a.py",), ("keep/build.py",), ("logs/keep.log",)))
def src_04(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(p,) for p in _PATHS], "path string")
    return d.filter(~W.ignored(F.col("path"), ["# made", "/src/gen", "build/", "*.log", "!logs/keep.log", "node_modules"]))


@query("src_08_tree", _rows("parent, children", ("", "build,deep,keep,logs,node_modules,src"), ("src", "gen,a.py"), ("src/gen", "b.py"), ("build", "c.py"), ("keep", "build.py"), ("logs", "keep.log,x.log"), ("deep", "logs"), ("deep/logs", "y.log"), ("node_modules", "m"), ("node_modules/m", "i.js")))
def src_08(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(p,) for p in _PATHS], "path string")
    return W.tree(d).select("parent", F.array_join("children", ",").alias("children"))


@query("prj_01_compact", _rows("file, compact", ("a.py", '[{"name":"greet","signature":"def greet(name: str) -> str","line":1},{"name":"farewell","signature":"def farewell(name: str) -> str","line":4}]'), ("b.py", '[{"name":"Greeter","signature":"class Greeter","line":3},{"name":"Greeter.run","signature":"def run(self) -> str","line":4},{"name":"Greeter.stop","signature":"def stop(self) -> None","line":7}]'), ("flow.py", '[{"name":"total","signature":"def total(xs, limit)","line":4},{"name":"main","signature":"def main()","line":13}]')))
def prj_01(spark: SparkSession, sf: str) -> DataFrame:
    return O.compact(facts(spark))


@query("snk_04_packed_json", "SELECT c_custkey AS id, '{\"i\":' || c_custkey || ',\"n\":' || to_json(c_name) || CASE WHEN c_acctbal >= 0 THEN ',\"s\":' || to_json(c_mktsegment) ELSE '' END || '}' AS packed FROM customer")
def snk_04(spark: SparkSession, sf: str) -> DataFrame:
    """Key aliases and no nulls."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    return c.select("id", O.packed_json({"id": "i", "name": "n", "segment": "s"}).alias("packed"))


@query("snk_06_from_columnar", "SELECT conv_id, turn, role FROM conversations")
def snk_06(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return O.from_columnar(O.columnar(c, "conv_id", ["turn", "role"], "turn"), "conv_id", ["turn", "role"])


@query("snk_01_text", "SELECT p_brand AS file, 'P' || (dense_rank() OVER (ORDER BY p_brand) - 1) || '=' || p_brand || chr(10) || string_agg(p_name || '  L' || p_size, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_brand")
def snk_01(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit("  L"), F.col("p_size").cast("string")).alias("line"))
    return O.ultracompact(p)


def manifest() -> str:
    """The operators as JSON (the capability manifest)."""
    from tessera import registry

    return json.dumps({"operators": sorted(registry.queries()), "checked": sorted(registry.oracle_sql())}, indent=1)
