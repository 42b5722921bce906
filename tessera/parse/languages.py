"""Imports and signatures of other languages by regular expressions: approximations, and labelled as such."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File extensions of each language.
EXTENSIONS = {
    "python": [".py"], "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs"], "go": [".go"], "rust": [".rs"], "java": [".java"],
    "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".cxx", ".hpp"], "ruby": [".rb"], "php": [".php"], "swift": [".swift"], "csharp": [".cs"],
    "kotlin": [".kt", ".kts"], "scala": [".scala"], "lua": [".lua"], "elixir": [".ex", ".exs"],
}
#: The module that a line imports, group 1.
IMPORTS = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "typescript": r"""(?:from|require\(|import)\s*['"]([^'"]+)['"]""", "javascript": r"""(?:from|require\(|import)\s*['"]([^'"]+)['"]""",
    "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$', "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "c": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', "cpp": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]',
    "ruby": r"""^\s*require(?:_relative)?\s*\(?\s*['"]([^'"]+)['"]""", "php": r"^\s*use\s+([\w\\]+)", "swift": r"^\s*import\s+(\w+)", "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "kotlin": r"^\s*import\s+([\w.]+)", "scala": r"^\s*import\s+([\w.]+)",
    "lua": r"""require\s*\(?\s*['"]([^'"]+)['"]""", "elixir": r"^\s*(?:alias|import|use|require)\s+([\w.]+)",
}
#: The name of a function that a line defines, group 1.
FUNCTIONS = {
    "python": r"^\s*(?:async\s+)?def\s+(\w+)", "typescript": r"(?:function\s+(\w+)|^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\()", "javascript": r"(?:function\s+(\w+)|^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\()",
    "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "java": r"^\s*(?:public|private|protected|static|final|\s)+[\w<>\[\],\s]+\s(\w+)\s*\([^;]*\{", "c": r"^[\w*\s]+?\b(\w+)\s*\([^;]*\)\s*\{", "cpp": r"^[\w:*&<>\s]+?\b(\w+)\s*\([^;]*\)\s*(?:const)?\s*\{",
    "ruby": r"^\s*def\s+(?:self\.)?(\w+[?!]?)", "php": r"function\s+(\w+)", "swift": r"\bfunc\s+(\w+)", "csharp": r"^\s*(?:public|private|protected|internal|static|async|override|virtual|\s)+[\w<>\[\],]+\s+(\w+)\s*\([^;]*\)", "kotlin": r"\bfun\s+(?:<[^>]*>\s*)?(\w+)", "scala": r"\bdef\s+(\w+)",
    "lua": r"function\s+([\w.:]+)", "elixir": r"^\s*defp?\s+(\w+[?!]?)",
}


def language(path: Column) -> Column:
    ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    out = F.lit(None).cast("string")
    for k, v in EXTENSIONS.items():
        out = F.when(ext.isin(v), k).otherwise(out)
    return out


def _first(pattern: str) -> Column:
    groups = [F.nullif(F.regexp_extract("line", pattern, i + 1), F.lit("")) for i in range(re.compile(pattern).groups)]
    return F.coalesce(*groups)


def _scan(files: DataFrame, table: dict[str, str], out: str) -> DataFrame:
    lines = files.select("path", "language", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = F.lit(None).cast("string")
    for k, p in table.items():
        found = F.when((F.col("language") == k) & F.rlike("line", F.lit(p)), _first(p)).otherwise(found)
    return lines.select("path", "language", (F.col("pos") + 1).alias("line_no"), found.alias(out)).filter(F.col(out).isNotNull())


def import_lines(files: DataFrame) -> DataFrame:
    """(path, language, line_no, module) of files (path, language, text)."""
    return _scan(files, IMPORTS, "module")


def function_lines(files: DataFrame) -> DataFrame:
    """(path, language, line_no, name)."""
    return _scan(files, FUNCTIONS, "name")
