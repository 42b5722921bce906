"""Benchmark records, result lines and agent traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON lines, a JSON list or {"data": [...]} by suffix and columns."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    d = spark.read.json(path, multiLine=path.endswith(".json"))
    return d.select(F.explode("data").alias("r")).select("r.*") if d.columns == ["data"] else d


def kind(columns: list[str]) -> str:
    """The dataset that records come from, by their keys."""
    c = set(columns)
    if {"problem_statement", "repo"} <= c:
        return "swebench"
    if "commit" in c or "repo_commit" in c:
        return "commit0"
    if {"dataset", "input"} <= c:
        return "longbench"
    return "repobench" if {"prompt"} <= c or "completion" in c else "unknown"


def first_of(columns: list[str], *names: str) -> Column:
    """The first of the named columns that isn't blank."""
    own = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in columns]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def normalise(records: DataFrame) -> DataFrame:
    """(instance_id, prompt, answer, split, metadata JSON) of records of any kind."""
    c = records.columns
    k = kind(c)
    ident = {"swebench": first_of(c, "instance_id", "id"), "commit0": first_of(c, "instance_id", "id", "repo"), "repobench": first_of(c, "id", "task_id"), "longbench": F.concat_ws(":", first_of(c, "dataset"), first_of(c, "id", "_id"))}.get(k, first_of(c, "id"))
    used = {"instance_id", "id", "_id", "task_id", "prompt", "input", "problem_statement", "question", "completion", "output", "patch", "answer", "split"}
    rest = [x for x in c if x not in used]
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return records.select(ident.alias("instance_id"), first_of(c, "prompt", "input", "problem_statement", "question").alias("prompt"), first_of(c, "completion", "output", "patch", "answer").alias("answer"), F.coalesce(first_of(c, "split"), F.lit("test")).alias("split"), meta.alias("metadata"))


_EVENT = "type string, item struct<type:string,command:string,aggregated_output:string,exit_code:int,status:string>, usage struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint>"


def trace_metrics(lines: DataFrame) -> DataFrame:
    """One row per trace of (trace, line): token sums, tool calls, output bytes, raw reads, compactions, malformed lines kept as a count.

    Lines aggregate straight from JSON with conditional sums; a line that isn't JSON is an error, not a loss."""
    d = lines.filter(F.trim("line") != "").withColumn("e", F.from_json("line", _EVENT, {"mode": "PERMISSIVE"}))
    bad = F.col("e.type").isNull()
    tool = F.col("e.type").isin("item.completed") & F.col("e.item.type").isin("command_execution", "mcp_tool_call")
    read = tool & F.col("e.item.command").rlike(r"\b(cat|sed|head|tail|less|nl)\b")
    total = F.coalesce("e.usage.input_tokens", F.lit(0)) + F.coalesce("e.usage.output_tokens", F.lit(0))
    return d.groupBy("trace").agg(
        F.sum(total).alias("total_tokens"), F.sum(F.coalesce("e.usage.cached_input_tokens", F.lit(0))).alias("cached_tokens"), F.count_if(tool).alias("tool_calls"),
        F.coalesce(F.sum(F.when(tool, F.octet_length("e.item.aggregated_output"))), F.lit(0)).alias("output_bytes"), F.count_if(read).alias("raw_reads"),
        F.count_if(F.col("e.type").contains("compact")).alias("compactions"), F.count_if(bad).alias("malformed"),
    )
