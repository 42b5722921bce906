"""Command line: python -m tessera COMMAND ROOT [ARGUMENTS]."""

from __future__ import annotations

import argparse

from tessera.api import Project
from tessera.session import session

COMMANDS = {
    "tree": [], "structure": [], "imports": [], "importers": ["module"], "search": ["pattern"], "structural": ["pattern"], "context": ["entry"], "pack": ["entry"], "impact": ["entry"],
    "affected_tests": ["entry"], "dead": [], "layers": [], "slice": ["function", "line"], "diff_context": [],
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        s = sub.add_parser(name)
        s.add_argument("root")
        for a in args:
            s.add_argument(a, type=int if a == "line" else str)
    sub.add_parser("manifest")
    a = vars(p.parse_args(argv))
    command = a.pop("command")
    if command == "manifest":
        from tessera.plans.records import manifest

        print(manifest())
        return
    spark = session("tessera", "local[*]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"})
    project = Project(spark, a.pop("root"))
    for row in getattr(project, command)(*a.values()).toJSON().toLocalIterator() if hasattr(project, command) else ():
        print(row)
    spark.stop()


if __name__ == "__main__":
    main()
