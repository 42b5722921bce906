"""The facade over a folder."""

from __future__ import annotations

import subprocess

import pytest

from tessera.api import LexicalBackend, Project
from tessera.plans.code import PROJECT


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in PROJECT.items():
        (root / name).write_text(text)
    (root / "copy").mkdir()
    (root / "copy" / "a2.py").write_text(PROJECT["a.py"])
    (root / "tests").mkdir()
    (root / "tests" / "test_b.py").write_text("from a import greet\n\ndef test_greet():\n    assert greet('x')\n")
    return Project(spark, str(root))


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_context_and_impact(project):
    assert ids(project.context("main"), "node", "depth") == [("a.py:farewell", 1), ("flow.py:main", 0), ("flow.py:total", 1)]
    assert ids(project.impact("a.py:greet"), "node", "depth") == [("a.py:greet", 0), ("b.py:Greeter.run", 1), ("tests/test_b.py:test_greet", 1)]
    assert ids(project.affected_tests("a.py:greet"), "test") == [("tests/test_b.py",)]


def test_equal_files_share_facts(project):
    assert ids(project.symbols.filter("file like 'copy/%'"), "symbol_id") == [("copy/a2.py:farewell",), ("copy/a2.py:greet",)]


def test_dead_and_slice(project):
    assert ids(project.dead(), "node") == [("copy/a2.py:farewell",), ("copy/a2.py:greet",)]
    assert ids(project.slice("flow.py:total", 11), "line") == [(4,), (5,), (6,), (9,), (11,)]


def test_pack_fits_its_budget(project):
    rows = project.pack("main", 40).collect()
    assert rows[0]["id"] == "flow.py:main" and rows[0]["code"].startswith("def main") and max(r["used"] for r in rows) <= 40


def test_search(project):
    assert ids(project.search(r"def greet"), "path", "pos") == [("a.py", 1), ("copy/a2.py", 1)]
    assert ids(project.importers("a"), "path") == [("b.py",), ("flow.py",), ("tests/test_b.py",)]
    b = LexicalBackend()
    b.build(project.files.selectExpr("path as id", "text"))
    assert b.search("greeter stop").first()["id"] == "b.py"


def test_diff_context(project):
    git = lambda *a: subprocess.run(["git", "-C", project.root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    with open(f"{project.root}/a.py", "a") as f:
        f.write("    # more\n")
    assert ids(Project(project.spark, project.root).diff_context(), "node", "relation") == [("a.py:farewell", "changed"), ("flow.py:main", "caller")]
