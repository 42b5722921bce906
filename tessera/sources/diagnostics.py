"""Outputs of type checkers and linters in one schema: tool, file, line, col, severity, message, rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PYRIGHT = "generalDiagnostics array<struct<file:string,severity:string,message:string,rule:string,range:struct<start:struct<line:int,character:int>>>>"
_RUFF = "array<struct<filename:string,code:string,message:string,location:struct<row:int,column:int>>>"
_ESLINT = "array<struct<filePath:string,messages:array<struct<line:int,column:int,severity:int,message:string,ruleId:string>>>>"
#: Line formats: file, line, column, severity, message, rule as group numbers (0: none).
LINES = {
    "tsc": (r"^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.*)$", (1, 2, 3, 4, 6, 5)),
    "gcc": (r"^(.+?):(\d+):(\d+): (error|warning|note): (.*?)(?: \[([^\]]+)\])?$", (1, 2, 3, 4, 5, 6)),
    "mypy": (r"^(.+?):(\d+): (error|warning|note): (.*?)(?:  \[([^\]]+)\])?$", (1, 2, 0, 3, 4, 5)),
    "flake8": (r"^(.+?):(\d+):(\d+): ([A-Z]\d+) (.*)$", (1, 2, 3, 0, 5, 4)),
    "luacheck": (r"^\s*(.+?):(\d+):(\d+): \((\w\d+)\) (.*)$", (1, 2, 3, 0, 5, 4)),
    "php": (r"^(?:PHP )?(Parse error|Fatal error|Warning): (.*) in (.+) on line (\d+)$", (3, 4, 0, 0, 2, 1)),
}
XML = ("checkstyle", "ktlint", "phpcs")


def diagnostics(outputs: DataFrame) -> DataFrame:
    """Rows of (tool, output); output that a tool's format doesn't match gives no row."""
    of = lambda *t: outputs.filter(F.col("tool").isin(*t))
    parts = []
    p = of("pyright", "basedpyright").select("tool", F.explode(F.from_json("output", _PYRIGHT)["generalDiagnostics"]).alias("d"))
    parts.append(p.select("tool", F.col("d.file"), (F.col("d.range.start.line") + 1).alias("line"), (F.col("d.range.start.character") + 1).alias("col"), "d.severity", "d.message", "d.rule"))
    r = of("ruff").select("tool", F.explode(F.from_json("output", _RUFF)).alias("d"))
    parts.append(r.select("tool", F.col("d.filename").alias("file"), F.col("d.location.row").alias("line"), F.col("d.location.column").alias("col"), F.lit("warning").alias("severity"), "d.message", F.col("d.code").alias("rule")))
    e = of("eslint").select("tool", F.explode(F.from_json("output", _ESLINT)).alias("f")).select("tool", F.col("f.filePath").alias("file"), F.explode("f.messages").alias("d"))
    parts.append(e.select("tool", "file", "d.line", F.col("d.column").alias("col"), F.when(F.col("d.severity") == 2, "error").otherwise("warning").alias("severity"), "d.message", F.col("d.ruleId").alias("rule")))
    for tool, (pattern, groups) in LINES.items():
        lines = of(tool).select("tool", F.explode(F.split("output", "\n")).alias("text")).filter(F.rlike("text", F.lit(pattern)))
        g = [F.nullif(F.regexp_extract("text", pattern, n), F.lit("")) if n else F.lit(None).cast("string") for n in groups]
        parts.append(lines.select("tool", g[0].alias("file"), g[1].cast("int").alias("line"), g[2].cast("int").alias("col"), F.coalesce(g[3], F.lit("warning")).alias("severity"), g[4].alias("message"), g[5].alias("rule")))
    x = of(*XML).select("tool", F.explode(F.regexp_extract_all("output", F.lit(r"(?s)<file\s.*?</file>"), 0)).alias("f"))
    attr = lambda c, a: F.regexp_extract(c, rf"""\s{a}=["']([^"']*)["']""", 1)
    x = x.select("tool", attr(F.regexp_extract("f", r"^<file[^>]*>", 0), "name").alias("file"), F.explode(F.regexp_extract_all("f", F.lit(r"<(?:error|warning)\s[^>]*>"), 0)).alias("e"))
    number = lambda a: F.try_to_number(attr("e", a), F.lit("999999999")).cast("int")
    parts.append(x.select("tool", "file", number("line").alias("line"), number("column").alias("col"), attr("e", "severity").alias("severity"), attr("e", "message").alias("message"), attr("e", "source").alias("rule")))
    return reduce(DataFrame.unionByName, parts)
