"""Facts of Python source from its syntax tree: symbols, imports, calls, control flow, definitions and uses."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FN = (ast.FunctionDef, ast.AsyncFunctionDef)


def _text(node: ast.AST | None) -> str | None:
    return ast.unparse(node) if node is not None else None


def _params(a: ast.arguments) -> list[str]:
    one = lambda x, star="": star + x.arg + (f": {_text(x.annotation)}" if x.annotation else "")
    out = [one(x) for x in (*a.posonlyargs, *a.args)]
    if a.vararg:
        out.append(one(a.vararg, "*"))
    out += [one(x) for x in a.kwonlyargs]
    return out + ([one(a.kwarg, "**")] if a.kwarg else [])


def symbols(tree: ast.Module) -> list[dict[str, Any]]:
    """Functions, classes and methods with their start lines; ranges are a window's work (see ``symbol_ranges``)."""
    out = []

    def add(node: ast.AST, kind: str, owner: str | None) -> None:
        fn = isinstance(node, FN)
        name = node.name
        q = f"{owner}.{name}" if owner else name
        params = _params(node.args) if fn else [_text(b) for b in node.bases]
        ret = _text(node.returns) if fn else None
        word = ("async def " if isinstance(node, ast.AsyncFunctionDef) else "def ") if fn else "class "
        sig = f"{word}{name}({', '.join(params)})" + (f" -> {ret}" if ret else "") if fn or params else f"class {name}"
        out.append({"kind": kind, "class_name": owner, "name": name, "qualified_name": q, "signature": sig, "params": params, "return_type": ret, "docstring": ast.get_docstring(node), "is_async": isinstance(node, ast.AsyncFunctionDef), "decorators": [_text(d) for d in node.decorator_list], "line": node.lineno})

    def walk(body: list[ast.stmt], owner: str | None) -> None:
        for n in body:
            if isinstance(n, FN):
                add(n, "method" if owner else "function", owner)
            elif isinstance(n, ast.ClassDef):
                q = f"{owner}.{n.name}" if owner else n.name
                add(n, "class", owner)
                walk(n.body, q)

    walk(tree.body, None)
    return out


def imports(tree: ast.Module) -> list[dict[str, Any]]:
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [{"module": a.name, "name": None, "alias": a.asname, "is_from": False, "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [{"module": "." * n.level + (n.module or ""), "name": a.name, "alias": a.asname, "is_from": True, "line": n.lineno} for a in n.names]
    return out


def calls(tree: ast.Module) -> list[dict[str, Any]]:
    """(caller, call_type, target): intra for names the file defines, direct for others, attr for dotted ones, ref for defined functions passed as values."""
    defined = {n.name for n in ast.walk(tree) if isinstance(n, (*FN, ast.ClassDef))}
    out: set[tuple[str, str, str]] = set()

    def dotted(n: ast.AST) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        left = dotted(n.value) if isinstance(n, ast.Attribute) else None
        return f"{left}.{n.attr}" if left else None

    def scan(n: ast.AST, caller: str) -> None:
        if isinstance(n, ast.Call):
            t = dotted(n.func)
            if t and "." not in t:
                out.add((caller, "intra" if t in defined else "direct", t))
            elif t:
                out.add((caller, "attr", t))
            for a in (*n.args, *(k.value for k in n.keywords)):
                if isinstance(a, ast.Name) and a.id in defined:
                    out.add((caller, "ref", a.id))
        for c in ast.iter_child_nodes(n):
            if isinstance(c, FN):
                inner(c, caller)
            elif isinstance(c, ast.ClassDef):
                inner(c, caller)
            else:
                scan(c, caller)

    def inner(n: ast.AST, caller: str) -> None:
        name = n.name if caller == "<module>" else f"{caller}.{n.name}"
        for c in n.body:
            if isinstance(c, (*FN, ast.ClassDef)):
                inner(c, name)
            else:
                scan(c, name if isinstance(n, FN) else "<module>")

    scan(tree, "<module>")
    return [{"caller": c, "call_type": t, "target": x} for c, t, x in sorted(out)]


class Flow:
    """Control flow of one function, statement by statement; statements in a row form a block.

    nodes: (id, line, kind); edges: (from, to, kind); control: (header line, line) for each statement nested in a header.
    """

    def __init__(self, fn: ast.FunctionDef | ast.AsyncFunctionDef):
        self.nodes: list[tuple[int, ast.AST | None, str]] = [(0, fn, "entry")]
        self.edges: set[tuple[int, int, str]] = set()
        self.control: set[tuple[int, int]] = set()
        self.decisions = 0
        self.exits: list[tuple[int, str]] = []
        ends = self._body(fn.body, [(0, "next")], None, None)
        last = self._add(None, "exit")
        self._join(ends + self.exits, last)

    def _add(self, stmt: ast.AST | None, kind: str) -> int:
        self.nodes.append((len(self.nodes), stmt, kind))
        return len(self.nodes) - 1

    def _join(self, ends: list[tuple[int, str]], to: int) -> None:
        self.edges |= {(a, to, k) for a, k in ends}

    def _body(self, body: list[ast.stmt], ends: list[tuple[int, str]], loop: tuple[int, list] | None, header: int | None) -> list[tuple[int, str]]:
        for s in body:
            kind = "branch" if isinstance(s, (ast.If, ast.Match, ast.Try)) else "loop" if isinstance(s, (ast.While, ast.For, ast.AsyncFor)) else "return" if isinstance(s, (ast.Return, ast.Raise)) else "body"
            n = self._add(s, kind)
            if header is not None:
                self.control.add((header, s.lineno))
            self._join(ends, n)
            if isinstance(s, ast.If):
                self.decisions += 1
                yes = self._body(s.body, [(n, "true")], loop, s.lineno)
                no = self._body(s.orelse, [(n, "false")], loop, s.lineno) if s.orelse else [(n, "false")]
                ends = yes + no
            elif isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
                self.decisions += 1
                breaks: list[tuple[int, str]] = []
                self._join(self._body(s.body, [(n, "true")], (n, breaks), s.lineno), n)
                ends = (self._body(s.orelse, [(n, "false")], loop, s.lineno) if s.orelse else [(n, "false")]) + breaks
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                ends = self._body(s.body, [(n, "next")], loop, header)
            elif isinstance(s, ast.Try):
                done = self._body(s.body, [(n, "next")], loop, header)
                for h in s.handlers:
                    self.decisions += 1
                    done += self._body(h.body, [(n, "except")], loop, s.lineno)
                done = self._body(s.orelse, done, loop, header) if s.orelse else done
                ends = self._body(s.finalbody, done, loop, header) if s.finalbody else done
            elif isinstance(s, ast.Match):
                ends = []
                for c in s.cases:
                    self.decisions += 1
                    ends += self._body(c.body, [(n, "case")], loop, s.lineno)
                ends.append((n, "false"))
            elif isinstance(s, (ast.Return, ast.Raise)):
                self.exits.append((n, "return"))
                ends = []
            elif isinstance(s, ast.Break) and loop:
                loop[1].append((n, "break"))
                ends = []
            elif isinstance(s, ast.Continue) and loop:
                self.edges.add((n, loop[0], "continue"))
                ends = []
            else:
                ends = [(n, "next")]
        return ends

    @property
    def complexity(self) -> int:
        return self.decisions + 1

    def blocks(self) -> list[dict[str, Any]]:
        out = []
        for i, s, kind in self.nodes:
            a = getattr(s, "lineno", 0)
            header = isinstance(s, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.AsyncWith, ast.Try, ast.Match, *FN))
            out.append({"id": i, "type": kind, "start_line": a, "end_line": a if header else getattr(s, "end_lineno", a)})
        return out


def refs(stmt: ast.AST) -> list[tuple[str, str, int, int]]:
    """(name, definition | update | use, line, column) of a statement without its nested body."""
    out: list[tuple[str, str, int, int]] = []
    if isinstance(stmt, FN):
        a = stmt.args
        return [(x.arg, "definition", x.lineno, x.col_offset) for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
    skip = {"body", "orelse", "finalbody", "handlers", "cases"} if isinstance(stmt, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.AsyncWith, ast.Try, ast.Match)) else set()
    todo = [c for f, v in ast.iter_fields(stmt) if f not in skip for c in (v if isinstance(v, list) else [v]) if isinstance(c, ast.AST)]
    if isinstance(stmt, (*FN, ast.ClassDef)):
        return [(stmt.name, "definition", stmt.lineno, stmt.col_offset)]
    if isinstance(stmt, ast.AugAssign) and isinstance(stmt.target, ast.Name):
        out.append((stmt.target.id, "update", stmt.target.lineno, stmt.target.col_offset))
        todo = [stmt.value]
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Name):
            out.append((n.id, "use" if isinstance(n.ctx, ast.Load) else "definition", n.lineno, n.col_offset))
        elif isinstance(n, (ast.Lambda, *FN, ast.ClassDef)):
            continue
        todo += list(ast.iter_child_nodes(n))
    return sorted(out, key=lambda r: (r[2], r[3], r[0]))


def reaching(flow: Flow) -> list[tuple[str, int, int]]:
    """(variable, definition line, use line): which definitions reach each use, by gen and kill sets until nothing changes."""
    own = {i: refs(s) if s is not None else [] for i, s, _ in flow.nodes}
    gen = {i: {(n, i) for n, t, _, _ in r if t != "use"} for i, r in own.items()}
    names = {i: {n for n, _ in g} for i, g in gen.items()}
    before: dict[int, set[tuple[int, int]]] = {i: set() for i in own}
    preds: dict[int, set[int]] = {i: set() for i in own}
    for a, b, _ in flow.edges:
        preds[b].add(a)
    out = {i: set(g) for i, g in gen.items()}
    moved = True
    while moved:
        moved = False
        for i in own:
            came = set().union(*[out[p] for p in preds[i]]) if preds[i] else set()
            left = gen[i] | {d for d in came if d[0] not in names[i]}
            if came != before[i] or left != out[i]:
                before[i], out[i], moved = came, left, True
    line = {i: getattr(s, "lineno", 0) for i, s, _ in flow.nodes}
    return sorted({(n, line[d], ln) for i, r in own.items() for n, t, ln, _ in r if t in ("use", "update") for m, d in before[i] if m == n})


def functions(tree: ast.Module) -> Iterator[tuple[str, ast.AST]]:
    def walk(body: list[ast.stmt], owner: str) -> Iterator[tuple[str, ast.AST]]:
        for n in body:
            if isinstance(n, FN):
                yield owner + n.name, n
                yield from walk(n.body, f"{owner}{n.name}.")
            elif isinstance(n, ast.ClassDef):
                yield from walk(n.body, f"{owner}{n.name}.")

    yield from walk(tree.body, "")


FACTS = "file string, fact string, function string, name string, kind string, module string, alias string, target string, signature string, text string, parts array<string>, a int, b int, n int"


def facts(path: str, text: str) -> Iterator[dict[str, Any]]:
    """All facts of a file as rows of one schema; a file that doesn't parse is one ``parse_error`` row."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield {"file": path, "fact": "parse_error", "text": str(e)}
        return
    total = len(text.splitlines())
    for s in symbols(tree):
        yield {"file": path, "fact": "symbol", "function": s["qualified_name"], "name": s["name"], "kind": s["kind"], "module": s["class_name"], "signature": s["signature"], "text": s["docstring"], "parts": s["params"], "a": s["line"], "b": total}
    for i in imports(tree):
        yield {"file": path, "fact": "import", "module": i["module"], "name": i["name"], "alias": i["alias"], "kind": "from" if i["is_from"] else "import", "a": i["line"]}
    for c in calls(tree):
        yield {"file": path, "fact": "call", "function": c["caller"], "kind": c["call_type"], "target": c["target"]}
    for name, fn in functions(tree):
        flow = Flow(fn)
        for b in flow.blocks():
            yield {"file": path, "fact": "cfg_block", "function": name, "kind": b["type"], "a": b["start_line"], "b": b["end_line"], "n": b["id"]}
        for x, y, k in sorted(flow.edges):
            yield {"file": path, "fact": "cfg_edge", "function": name, "kind": k, "a": x, "b": y}
        yield {"file": path, "fact": "complexity", "function": name, "n": flow.complexity}
        for i, s, _ in flow.nodes:
            for v, t, ln, col in refs(s) if s is not None else []:
                yield {"file": path, "fact": "ref", "function": name, "name": v, "kind": t, "a": ln, "b": col, "n": i}
        for v, d, u in reaching(flow):
            yield {"file": path, "fact": "dfg_edge", "function": name, "name": v, "a": d, "b": u}
        for h, ln in sorted(flow.control):
            yield {"file": path, "fact": "control_edge", "function": name, "a": h, "b": ln}


_ARROW = pa.schema([(c, pa.int32() if t == "int" else pa.list_(pa.string()) if t.startswith("array") else pa.string()) for c, t in (x.split() for x in FACTS.split(", "))])


def parse(files: DataFrame) -> DataFrame:
    """Facts of files (path, text): one pass for all that follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(list(facts(p, t or "")), _ARROW)

    return files.select("path", "text").mapInArrow(run, FACTS)


def symbol_ranges(found: DataFrame) -> DataFrame:
    """(file, symbol_id, kind, name, qualified_name, signature, start_line, end_line): a symbol ends before the next of its level, the last with its class or file."""
    from pyspark.sql import Window as W

    s = found.filter("fact = 'symbol'").select("file", F.concat_ws(":", "file", "function").alias("symbol_id"), "kind", F.col("module").alias("owner"), "name", F.col("function").alias("qualified_name"), "signature", F.col("a").alias("start_line"), F.col("b").alias("total"))
    w = W.partitionBy("file", "owner").orderBy("start_line")
    s = s.withColumn("next", F.lead("start_line").over(w) - 1)
    top = s.filter("owner is null").withColumn("end_line", F.greatest("start_line", F.coalesce("next", "total")))
    ends = top.select("file", F.col("qualified_name").alias("owner"), F.col("end_line").alias("owner_end"))
    rest = s.filter("owner is not null").join(ends, ["file", "owner"], "left").withColumn("end_line", F.greatest("start_line", F.coalesce("next", "owner_end", "total")))
    cols = ["file", "symbol_id", "kind", "name", "qualified_name", "signature", "start_line", "end_line"]
    return top.select(*cols).unionByName(rest.select(*cols))


def dependence(found: DataFrame) -> DataFrame:
    """Program dependence edges (file, function, src line, dst line, kind control or data, label)."""
    c = found.filter("fact = 'control_edge'").select("file", "function", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("control").alias("kind"), F.lit(None).cast("string").alias("label"))
    d = found.filter("fact = 'dfg_edge' and a <> b").select("file", "function", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("data").alias("kind"), F.col("name").alias("label"))
    return c.unionByName(d).distinct()
