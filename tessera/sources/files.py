"""Workspace scans with ignore patterns, as binary-file reads with predicates."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.parse.languages import EXTENSIONS, language

#: Largest file that is read for facts, in bytes; and for task excerpts.
LARGEST, EXCERPT = 5 * 1024 * 1024, 250_000


class PathTraversal(ValueError):
    """A path leaves its base."""


def contained(path: str, base: str) -> str:
    """The real path, if it lies in ``base``."""
    if "\0" in path:
        raise PathTraversal("a path can't hold a null byte")
    real, root = os.path.realpath(os.path.join(base, path)), os.path.realpath(base)
    if real != root and not real.startswith(root + os.sep):
        raise PathTraversal(f"{path} is outside of {base}")
    return real


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """An ignore-file line as (regular expression over root-relative paths, negated); None for blanks and comments."""
    p = pattern.rstrip("\n").rstrip()
    if not p or p.startswith("#"):
        return None
    negated = p.startswith("!")
    p = p[negated:]
    below = p.endswith("/")
    p = p.rstrip("/")
    rooted = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i:]:
            j = p.index("]", i)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return f"^{'' if rooted else '(?:.*/)?'}{out}{'/.*' if below else '(?:/.*)?'}$", negated


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a root-relative path is ignored: the last pattern that matches decides."""
    out = F.lit(False)
    for p in patterns:
        found = ignore_regex(p)
        if found:
            out = F.when(path.rlike(found[0]), not found[1]).otherwise(out)
    return out


def workspace_config(root: str) -> tuple[list[str], list[str]]:
    """(active packages, exclude patterns) of a workspace file, empty without one."""
    for name in ("workspace.json", ".workspace.json"):
        at = os.path.join(root, name)
        if os.path.exists(at):
            data = json.load(open(at, encoding="utf-8"))
            return list(data.get("activePackages", [])), list(data.get("excludePatterns", []))
    return [], []


def files(spark: SparkSession, root: str, languages: list[str] | None = None, patterns: list[str] = (), packages: list[str] = (), hidden: bool = False, largest: int = LARGEST) -> DataFrame:
    """(path relative to the root, language, text, size, mtime, sha256). Unknown languages raise.

    Size and path predicates are on the file source's own columns, so content of other files isn't read.
    """
    for x in languages or ():
        if x not in EXTENSIONS:
            raise ValueError(f"unknown language: {x}")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= largest)
    base = os.path.realpath(root) if "://" not in root else root
    rel = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(base.lstrip("/")) + "/?", "")
    d = raw.withColumn("path", rel)
    if not hidden:
        d = d.filter(~F.rlike("path", F.lit(r"(^|/)\.[^/]")))
    if patterns:
        d = d.filter(~ignored(F.col("path"), list(patterns)))
    if packages:
        d = d.filter(F.rlike("path", F.lit("^(?:" + "|".join(re.escape(p.rstrip("/")) for p in packages) + ")/")))
    d = d.withColumn("language", language(F.col("path")))
    if languages:
        d = d.filter(F.col("language").isin(list(languages)))
    return d.select("path", "language", F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))


def recent_hunks(found: DataFrame, n: int = 5) -> DataFrame:
    """Whole-file hunks of the ``n`` files changed last."""
    return found.orderBy(F.desc("mtime"), "path").limit(n).select("path", F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"))


def tree(found: DataFrame) -> DataFrame:
    """(parent, children): the names in each folder, folders first, without regard to case."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.concat_ws("/", F.slice(parts, 1, i - 1)).alias("parent"), (i == F.size(parts)).alias("leaf"), F.lower(F.get(parts, i - 1)).alias("order"), F.get(parts, i - 1).alias("name")))
    d = found.select(F.explode(steps).alias("s")).select("s.*").distinct()
    return d.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "order", "name"))), lambda x: x["name"]).alias("children"))
