"""Structural search: patterns of Python with $X for one node and $$$X for a list of arguments."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _pattern(text: str) -> ast.AST:
    node = ast.parse(re.sub(r"\$(\w+)", r"__one_\1", re.sub(r"\$\$\$(\w+)", r"__many_\1", text))).body[0]
    return node.value if isinstance(node, ast.Expr) else node


def _match(p: ast.AST, n: ast.AST, got: dict[str, str]) -> bool:
    if isinstance(p, ast.Name) and p.id.startswith("__one_"):
        name, text = p.id[6:], ast.unparse(n)
        return got.setdefault(name, text) == text
    if type(p) is not type(n):
        return False
    for f in p._fields:
        a, b = getattr(p, f, None), getattr(n, f, None)
        if isinstance(a, list):
            many = next((x for x in a if isinstance(x, ast.Name) and x.id.startswith("__many_")), None)
            if many is not None and len(a) == 1:
                got[many.id[7:]] = ", ".join(ast.unparse(x) for x in b)
                continue
            if len(a) != len(b) or not all(_match(x, y, got) if isinstance(x, ast.AST) else x == y for x, y in zip(a, b, strict=True)):
                return False
        elif isinstance(a, ast.AST):
            if not isinstance(b, ast.AST) or not _match(a, b, got):
                return False
        elif f != "ctx" and a != b:
            return False
    return True


def find(text: str, pattern: str) -> Iterator[tuple[int, int, str, dict[str, str]]]:
    """(line, end line, text, captures) of each match, in order of place."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    p = _pattern(pattern)
    found = []
    for n in ast.walk(tree):
        got: dict[str, str] = {}
        if isinstance(n, type(p)) and _match(p, n, got):
            found.append((n.lineno, n.end_lineno, ast.unparse(n), got))
    yield from sorted(found, key=lambda x: x[:3])


def matches(files: DataFrame, pattern: str) -> DataFrame:
    """(path, line, end_line, text, captures) over files (path, text); limits and budgets are the caller's."""
    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string()), ("captures", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, "line": a, "end_line": e, "text": t, "captures": list(c.items())} for p, src in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True) for a, e, t, c in find(src or "", pattern)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "text").mapInArrow(run, "path string, line int, end_line int, text string, captures map<string,string>")
