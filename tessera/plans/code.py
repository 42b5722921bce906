"""Queries over source code: a fixture project, as the driver's tables hold none. The SQL states the rows expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import relational as R
from tessera.parse import languages as L
from tessera.parse import python_facts as P
from tessera.registry import query
from tessera.sources import diagnostics as D
from tessera.sources import diff as V

PROJECT = {
    "a.py": 'def greet(name: str) -> str:\n    return f"Hello {name}"\n\ndef farewell(name: str) -> str:\n    return f"Bye {name}"\n',
    "b.py": "from a import greet\n\nclass Greeter:\n    def run(self) -> str:\n        return greet('world')\n\n    def stop(self) -> None:\n        pass\n",
    "flow.py": "import os as o\nimport a\n\ndef total(xs, limit):\n    s = 0\n    for x in xs:\n        if x > limit:\n            break\n        s += x\n    o.getcwd()\n    return s\n\ndef main():\n    t = total([1], 2)\n    a.farewell(t)\n    return map(total, [t])\n",
    "bad.py": "def broken(:\n",
}
OTHERS = {
    "x.ts": "import { y } from './y'\nexport const f = async (a) => a\nfunction g() {}\n", "x.go": 'import "fmt"\nfunc (s *S) Run() {}\n', "x.rs": "use std::io;\npub fn run() {}\n", "X.java": "import java.util.List;\n  public static int run(int a) {\n",
    "x.c": "#include <stdio.h>\nint main(int a) {\n", "x.rb": "require 'json'\ndef run!\nend\n", "x.php": "use App\\Model;\nfunction run() {}\n", "x.swift": "import UIKit\nfunc run() {}\n", "x.cs": "using System.Text;\n  public void Run(int a) {\n",
    "x.kt": "import a.b\nfun run() {}\n", "x.scala": "import a.b\ndef run = 1\n", "x.lua": "local m = require('m')\nfunction m.run() end\n", "x.ex": "alias A.B\ndef run do\n",
}


def _rows(names: str, *rows: tuple) -> str:
    """SQL for expected rows."""
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


def project(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(PROJECT.items()), "path string, text string")


def facts(spark: SparkSession) -> DataFrame:
    return P.parse(project(spark))


@query("src_13_symbols", _rows("symbol_id, kind, start_line, end_line", ("a.py:greet", "function", 1, 3), ("a.py:farewell", "function", 4, 5), ("b.py:Greeter", "class", 3, 8), ("b.py:Greeter.run", "method", 4, 6), ("b.py:Greeter.stop", "method", 7, 8), ("flow.py:total", "function", 4, 12), ("flow.py:main", "function", 13, 16)))
def src_13(spark: SparkSession, sf: str) -> DataFrame:
    return P.symbol_ranges(facts(spark)).select("symbol_id", "kind", "start_line", "end_line")


@query("src_21_signatures", _rows("symbol_id, signature", ("a.py:greet", "def greet(name: str) -> str"), ("a.py:farewell", "def farewell(name: str) -> str"), ("b.py:Greeter", "class Greeter"), ("b.py:Greeter.run", "def run(self) -> str"), ("b.py:Greeter.stop", "def stop(self) -> None"), ("flow.py:total", "def total(xs, limit)"), ("flow.py:main", "def main()")))
def src_21(spark: SparkSession, sf: str) -> DataFrame:
    return P.symbol_ranges(facts(spark)).select("symbol_id", "signature")


@query("src_22_imports", _rows("file, module, name, alias", ("b.py", "a", "greet", None), ("flow.py", "os", None, "o"), ("flow.py", "a", None, None)))
def src_22(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark).filter("fact = 'import'").select("file", "module", "name", "alias")


@query("src_27_calls", _rows("file, caller, call_type, target", ("b.py", "Greeter.run", "direct", "greet"), ("flow.py", "total", "attr", "o.getcwd"), ("flow.py", "main", "intra", "total"), ("flow.py", "main", "attr", "a.farewell"), ("flow.py", "main", "direct", "map"), ("flow.py", "main", "ref", "total")))
def src_27(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark).filter("fact = 'call'").select("file", F.col("function").alias("caller"), F.col("kind").alias("call_type"), "target")


def call_graph(found: DataFrame) -> DataFrame:
    calls = found.filter("fact = 'call'").select("file", F.col("function").alias("caller"), F.col("kind").alias("call_type"), "target")
    imports = found.filter("fact = 'import'").select("file", "module", "name", "alias")
    index = R.function_index(found.filter("fact = 'symbol' and kind <> 'method'").select("file", "name"))
    return R.resolve_calls(calls, imports, index)


@query("jon_04_call_graph", _rows("src_file, src_func, dst_file, dst_func", ("b.py", "Greeter.run", "a.py", "greet"), ("flow.py", "main", "a.py", "farewell"), ("flow.py", "main", "flow.py", "total")))
def jon_04(spark: SparkSession, sf: str) -> DataFrame:
    return call_graph(facts(spark))


@query("src_29_complexity", _rows("file, function, complexity", ("a.py", "greet", 1), ("a.py", "farewell", 1), ("b.py", "Greeter.run", 1), ("b.py", "Greeter.stop", 1), ("flow.py", "total", 3), ("flow.py", "main", 1)))
def src_29(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark).filter("fact = 'complexity'").select("file", "function", F.col("n").alias("complexity"))


@query("src_29_cfg_edges", _rows("a, b, kind", (0, 1, "next"), (1, 2, "next"), (2, 3, "true"), (3, 4, "true"), (3, 5, "false"), (5, 2, "next"), (2, 6, "false"), (4, 6, "break"), (6, 7, "next"), (7, 8, "return")))
def src_29_edges(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark).filter("fact = 'cfg_edge' and function = 'total'").select("a", "b", "kind")


@query("src_33_refs", _rows("name, kind, line", ("xs", "definition", 4), ("limit", "definition", 4), ("s", "definition", 5), ("x", "definition", 6), ("xs", "use", 6), ("x", "use", 7), ("limit", "use", 7), ("s", "update", 9), ("x", "use", 9), ("o", "use", 10), ("s", "use", 11)))
def src_33(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark).filter("fact = 'ref' and function = 'total'").select("name", "kind", F.col("a").alias("line"))


@query("gra_08_reaching_definitions", _rows("name, def_line, use_line", ("xs", 4, 6), ("limit", 4, 7), ("x", 6, 7), ("x", 6, 9), ("s", 5, 9), ("s", 9, 9), ("s", 5, 11), ("s", 9, 11)))
def gra_08(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark).filter("fact = 'dfg_edge' and function = 'total'").select("name", F.col("a").alias("def_line"), F.col("b").alias("use_line"))


@query("gra_07_dependence", _rows("src, dst, kind", (4, 6, "data"), (4, 7, "data"), (6, 7, "data"), (6, 9, "data"), (5, 9, "data"), (5, 11, "data"), (9, 11, "data"), (6, 7, "control"), (6, 9, "control"), (7, 8, "control")))
def gra_07(spark: SparkSession, sf: str) -> DataFrame:
    return P.dependence(facts(spark)).filter("function = 'total'").select("src", "dst", "kind")


@query("gra_05_program_slice", _rows("line", (11,), (5,), (9,), (6,), (4,)))
def gra_05_slice(spark: SparkSession, sf: str) -> DataFrame:
    """What line 11 of the function depends on."""
    d = P.dependence(facts(spark)).filter("function = 'total'").select("src", "dst").distinct()
    start = spark.createDataFrame([(11,)], "node int")
    return G.closure(G.reversed_edges(d), start).select(F.col("node").alias("line"))


@query("src_11_parse_errors", _rows("file", ("bad.py",)))
def src_11(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark).filter("fact = 'parse_error'").select("file")


@query("src_23_other_imports", _rows("path, module", ("x.ts", "./y"), ("x.go", "fmt"), ("x.rs", "std::io"), ("X.java", "java.util.List"), ("x.c", "stdio.h"), ("x.rb", "json"), ("x.php", "App\\Model"), ("x.swift", "UIKit"), ("x.cs", "System.Text"), ("x.kt", "a.b"), ("x.scala", "a.b"), ("x.lua", "m"), ("x.ex", "A.B")))
def src_23(spark: SparkSession, sf: str) -> DataFrame:
    return L.import_lines(_others(spark)).select("path", "module")


@query("src_14_other_functions", _rows("path, name", ("x.ts", "f"), ("x.ts", "g"), ("x.go", "Run"), ("x.rs", "run"), ("X.java", "run"), ("x.c", "main"), ("x.rb", "run!"), ("x.php", "run"), ("x.swift", "run"), ("x.cs", "Run"), ("x.kt", "run"), ("x.scala", "run"), ("x.lua", "m.run"), ("x.ex", "run")))
def src_14(spark: SparkSession, sf: str) -> DataFrame:
    return L.function_lines(_others(spark)).select("path", "name")


def _others(spark: SparkSession) -> DataFrame:
    f = spark.createDataFrame(sorted(OTHERS.items()), "path string, text string")
    return f.withColumn("language", L.language(F.col("path")))


DIFF = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,0 +1,2 @@\n+x\n+y\n@@ -9 +12 @@ def f\n-old\n+new\ndiff --git a/gone.py b/gone.py\n--- a/gone.py\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-a\n"


@query("src_37_diff", _rows("file, start_line, end_line", ("a.py", 1, 2), ("a.py", 12, 12)))
def src_37(spark: SparkSession, sf: str) -> DataFrame:
    return V.hunks(spark.createDataFrame([("d", DIFF)], "diff_id string, text string")).select("file", "start_line", "end_line")


_TOOLS = {
    "pyright": '{"generalDiagnostics":[{"file":"a.py","severity":"error","message":"bad","rule":"r1","range":{"start":{"line":3,"character":4}}}]}',
    "ruff": '[{"filename":"b.py","code":"F401","message":"unused","location":{"row":2,"column":1}}]',
    "tsc": "src/x.ts(3,7): error TS2304: Cannot find name 'q'.\nnoise\n",
    "gcc": "x.c:10:5: warning: unused variable 'y' [-Wunused]\n",
    "checkstyle": '<checkstyle><file name="A.java"><error line="4" column="2" severity="warning" message="long" source="L"/></file></checkstyle>',
}


@query("src_47_diagnostics", _rows("tool, file, line, col, severity, message, rule", ("pyright", "a.py", 4, 5, "error", "bad", "r1"), ("ruff", "b.py", 2, 1, "warning", "unused", "F401"), ("tsc", "src/x.ts", 3, 7, "error", "Cannot find name 'q'.", "TS2304"), ("gcc", "x.c", 10, 5, "warning", "unused variable 'y'", "-Wunused"), ("checkstyle", "A.java", 4, 2, "warning", "long", "L")))
def src_47(spark: SparkSession, sf: str) -> DataFrame:
    return D.diagnostics(spark.createDataFrame(sorted(_TOOLS.items()), "tool string, output string"))
