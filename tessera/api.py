"""The engine over a folder of source code: one parse pass, then relational questions."""

from __future__ import annotations

import functools
import subprocess
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import formats
from tessera.operators import graph as G
from tessera.operators import packing as P
from tessera.operators import relational as R
from tessera.operators import search as S
from tessera.parse import languages as L
from tessera.parse import python_facts as Y
from tessera.parse import structural
from tessera.shared import cut
from tessera.sources import diff as V
from tessera.sources import files as W

#: Names that frameworks or people call, never dead.
ENTRY = r"(?i)main|test|app|run|setup|handler|__\w+__"
#: Bundles of options.
PRESETS = {"compact": {"budget": 2000, "depth": 2}, "minimal": {"budget": 1500, "depth": 1}, "multi-turn": {"budget": 2000, "depth": 2, "delta": True}}


class Backend(Protocol):
    """What a search backend offers."""

    def build(self, units: DataFrame) -> None: ...
    def search(self, query: str, k: int) -> DataFrame: ...


class LexicalBackend:
    """BM25 over units (id, text), kept as a table of the shared folder."""

    def build(self, units: DataFrame) -> None:
        self.units = cut(units.select("id", "text"), "units")

    def search(self, query: str, k: int = 10) -> DataFrame:
        terms = [t for t in query.lower().split() if t]
        return S.bm25(self.units, terms, "id", "text", max(1, min(k, 50)))


def memo(f: Callable) -> Callable:
    """A result is kept for as long as the project's content has the same fingerprint."""
    kept: dict = {}

    @functools.wraps(f)
    def run(self: Project, *args):
        key = (f.__name__, args, self.fingerprint())
        if key not in kept:
            kept[key] = f(self, *args)
        return kept[key]

    return run


class Project:
    """A workspace: files, facts, symbols and call edges as DataFrames."""

    def __init__(self, spark: SparkSession, root: str, languages: list[str] | None = None, patterns: list[str] | None = None):
        packages, excluded = W.workspace_config(root)
        self.spark, self.root = spark, root
        self.files = W.files(spark, root, languages, [*(patterns or ["node_modules/", "dist/", "build/", "__pycache__/"]), *excluded], packages)

    def fingerprint(self) -> str:
        """A hash of all paths and contents, by an aggregate that needs no order."""
        return str(self.files.agg(F.bit_xor(F.xxhash64("path", "sha256")), F.count("*")).first())

    @functools.cached_property
    def facts(self) -> DataFrame:
        """Facts of the Python files; each distinct content is parsed once and its facts go to every path that has it."""
        py = self.files.filter("language = 'python'")
        once = py.groupBy("sha256").agg(F.min("path").alias("path"), F.any_value("text").alias("text"))
        found = Y.parse(once.select(F.col("sha256").alias("path"), "text")).withColumnRenamed("file", "sha256")
        return cut(py.select("sha256", F.col("path").alias("file")).join(found, "sha256").drop("sha256"), "facts")

    @functools.cached_property
    def symbols(self) -> DataFrame:
        return Y.symbol_ranges(self.facts)

    @functools.cached_property
    def edges(self) -> DataFrame:
        """Call edges between symbol ids (src, dst)."""
        f = self.facts
        calls = f.filter("fact = 'call'").select("file", F.col("function").alias("caller"), F.col("kind").alias("call_type"), "target")
        imports = f.filter("fact = 'import'").select("file", "module", "name", "alias")
        index = R.function_index(f.filter("fact = 'symbol' and kind <> 'method'").select("file", "name"))
        e = R.resolve_calls(calls, imports, index)
        return cut(e.select(F.concat_ws(":", "src_file", "src_func").alias("src"), F.concat_ws(":", "dst_file", "dst_func").alias("dst")), "edges")

    def tree(self) -> DataFrame:
        return W.tree(self.files)

    def structure(self) -> DataFrame:
        return formats.compact(self.facts)

    def imports(self) -> DataFrame:
        return L.import_lines(self.files)

    def importers(self, module: str) -> DataFrame:
        """Files that import a module or what is below it."""
        m = F.col("module")
        return self.imports().filter((m == module) | m.startswith(module + ".")).select("path").distinct()

    def search(self, pattern: str, context: int = 1, limit: int = 100) -> DataFrame:
        return S.line_search(self.files, pattern, "path", "text", context, limit)

    def structural(self, pattern: str) -> DataFrame:
        return structural.matches(self.files.filter("language = 'python'"), pattern)

    def resolve(self, entry: str) -> DataFrame:
        """(node): the symbols that an entry names, by the first of: id, end of the path with name, qualified name, bare name."""
        s = self.symbols
        stage = F.when(F.col("symbol_id") == entry, 1).when(F.endswith("symbol_id", F.lit("/" + entry)), 2).when(F.col("qualified_name") == entry, 3).when(F.col("name") == entry, 4)
        found = s.select(F.col("symbol_id").alias("node"), stage.alias("stage")).filter("stage is not null")
        return found.join(F.broadcast(found.agg(F.min("stage").alias("stage"))), "stage").select("node")

    @memo
    def context(self, entry: str, depth: int = 2) -> DataFrame:
        """(node, depth, signature, complexity) of what an entry calls."""
        c = self.facts.filter("fact = 'complexity'").select(F.concat_ws(":", "file", "function").alias("node"), F.col("n").alias("complexity"))
        s = self.symbols.select(F.col("symbol_id").alias("node"), "signature", "start_line", "end_line")
        return G.reach(self.edges, self.resolve(entry), depth).select("node", "depth").join(s, "node").join(c, "node", "left")

    def pack(self, entry: str, budget: int = 2000, depth: int = 2) -> DataFrame:
        """The context under a token budget: nearest first, whole bodies while they fit, then signatures."""
        body = self.files.select(F.col("path").alias("file"), F.split("text", "\n").alias("ls"))
        c = self.context(entry, depth).withColumn("file", F.regexp_extract("node", "^(.*):[^:]*$", 1)).join(body, "file")
        code = F.array_join(F.slice("ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
        tokens = lambda x: F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("double")
        c = c.select(F.lit("pack").alias("pack"), "depth", "node", F.col("node").alias("sid"), "signature", code.alias("code")).withColumns({"full": tokens(F.col("code")), "sig": tokens(F.col("signature"))})
        return P.greedy(c, "pack", ["depth", "node"], "sid", "full", "sig", F.lit(budget)).drop("pack").join(c.select(F.col("sid").alias("id"), "signature", "code"), "id").withColumn("code", F.when(F.col("choice") == "full", F.col("code"))).orderBy("pos")

    def impact(self, entry: str, depth: int = 3) -> DataFrame:
        """(node, depth, parent): who calls an entry, and who calls them."""
        return G.reach(G.reversed_edges(self.edges), self.resolve(entry), depth)

    def affected_tests(self, entry: str, depth: int = 5) -> DataFrame:
        file = F.regexp_extract("node", "^(.*):[^:]*$", 1)
        return self.impact(entry, depth).filter(file.rlike(r"(^|/)(tests?|__tests__)/|(^|/)test_[^/]*$|_test\.[^/]*$")).select(file.alias("test")).distinct()

    def dead(self) -> DataFrame:
        nodes = self.symbols.filter("kind = 'function'").filter(~F.rlike("name", F.lit(ENTRY))).select(F.col("symbol_id").alias("node"))
        return G.dead(nodes, self.edges)

    def layers(self) -> DataFrame:
        return G.layers(self.edges)

    def slice(self, function: str, line: int, forward: bool = False) -> DataFrame:
        """Lines of a function that a line depends on, or that depend on it."""
        d = Y.dependence(self.facts).filter(F.concat_ws(":", "file", "function") == function).select("src", "dst").distinct()
        start = self.spark.createDataFrame([(line,)], "node int")
        return G.closure(d if forward else G.reversed_edges(d), start).select(F.col("node").alias("line"))

    def changed(self, base: str = "HEAD") -> DataFrame:
        """Hunks of the work tree against a commit; without a repository, the five files changed last."""
        got = subprocess.run(["git", "-C", self.root, "diff", "--unified=0", base], capture_output=True, text=True)
        if got.returncode or not got.stdout.strip():
            return W.recent_hunks(self.files).withColumnRenamed("path", "file")
        return V.hunks(self.spark.createDataFrame([("d", got.stdout)], "diff_id string, text string")).drop("diff_id")

    def diff_context(self, base: str = "HEAD") -> DataFrame:
        """(node, relation): symbols that a diff touches, their callees and their callers."""
        h = self.changed(base).select(F.monotonically_increasing_id().alias("hunk"), "file", F.col("start_line").alias("h_start"), F.col("end_line").alias("h_end"))
        touched = R.narrowest(cut(h, "hunks"), self.symbols).select(F.col("symbol_id").alias("node")).distinct()
        return G.neighbourhood(self.edges, touched)
