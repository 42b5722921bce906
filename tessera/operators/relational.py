"""Joins, interval logic, sequence logic and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def resolve_calls(calls: DataFrame, imports: DataFrame, index: DataFrame) -> DataFrame:
    """Call edges (src_file, src_func, dst_file, dst_func), distinct; unresolved calls go.

    ``calls`` has (file, caller, call_type, target), ``imports`` (file, module,
    name, alias), ``index`` (module_key, name, file). A direct call goes over
    the import of its name and looks it up under the last part of the module,
    then under the whole; an attribute call over the module's alias; intra and
    ref calls stay in their file. All joins are equi-joins.
    """
    last = F.element_at(F.split("module", r"\."), -1)
    named = imports.withColumns({"local": F.coalesce("alias", "name", last), "short": last})
    key = F.col("target")
    direct = calls.filter("call_type = 'direct'").join(named.filter("name is not null").select("file", F.col("local").alias("target"), "module", "short", F.col("name").alias("real")), ["file", "target"])
    attr = calls.filter("call_type = 'attr'").withColumns({"head": F.substring_index(key, ".", 1), "real": F.element_at(F.split(key, r"\."), -1)})
    attr = attr.join(named.filter("name is null").select("file", F.col("local").alias("head"), "module", "short"), ["file", "head"])
    cols = ["file", "caller", "module", "short", "real"]
    far = direct.select(*cols).unionByName(attr.select(*cols))
    by = lambda k, out: index.select(F.col("module_key").alias(k), F.col("name").alias("real"), F.col("file").alias(out))
    far = far.join(by("short", "near_file"), ["short", "real"], "left").join(by("module", "far_file"), ["module", "real"], "left")
    far = far.withColumn("dst_file", F.coalesce("near_file", "far_file")).filter("dst_file is not null")
    own = calls.filter("call_type in ('intra', 'ref')").select(F.col("file").alias("src_file"), F.col("caller").alias("src_func"), F.col("file").alias("dst_file"), key.alias("dst_func"))
    return far.select(F.col("file").alias("src_file"), F.col("caller").alias("src_func"), "dst_file", F.col("real").alias("dst_func")).unionByName(own).distinct()


def function_index(symbols: DataFrame) -> DataFrame:
    """(module_key, name, file) under the whole module and its last part; of several files the last by path."""
    module = F.replace(F.regexp_replace("file", r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))
    keys = F.array_distinct(F.array(module, F.element_at(F.split(module, r"\."), -1)))
    return symbols.select(F.explode(keys).alias("module_key"), "name", "file").groupBy("module_key", "name").agg(F.max("file").alias("file"))


def narrowest(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(hunk, symbol_id, span): of the symbols that overlap a hunk the one with the fewest lines, then the least id.

    An interval join within a file: both sides are cut in bins of lines, so
    that the join is an equi-join on (file, bin); the overlap is then checked
    and a hunk's symbols meet in one aggregate instead of a sort.
    """
    size = 64
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))).alias("bin")
    h = hunks.select("*", bins("h_start", "h_end"))
    s = symbols.select("file", "symbol_id", "start_line", "end_line", bins("start_line", "end_line"))
    met = h.join(s, ["file", "bin"]).filter("start_line <= h_end and end_line >= h_start")
    best = F.min(F.struct((F.col("end_line") - F.col("start_line") + 1).alias("span"), "symbol_id"))
    return met.groupBy("hunk").agg(best.alias("b")).select("hunk", "b.symbol_id", "b.span")


def as_of(events: DataFrame, key: str, order: list[str], when: Column, value: str, out: str) -> DataFrame:
    """Each row with the last earlier ``value`` of a row of its key for which ``when`` holds: one sort per key, no join."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn(out, F.last(F.when(when, F.col(value)), ignorenulls=True).over(w))


def as_of_version(versions: DataFrame, key: str, at: Column, order: str) -> DataFrame:
    """The newest version of each key that isn't newer than ``at``."""
    return versions.filter(F.col(order) <= at).groupBy(key).agg(F.max_by(F.struct(*[c for c in versions.columns if c != key]), order).alias("v")).select(key, "v.*")


def end_lines(starts: DataFrame, within: str, start: str, last: Column) -> DataFrame:
    """Adds end_line: the next start less one, at least the start; the last symbol ends with its file."""
    nxt = F.lead(start).over(W.partitionBy(within).orderBy(start))
    return starts.withColumn("end_line", F.greatest(F.col(start), F.coalesce(nxt - 1, last)))


def merge_windows(windows: DataFrame, key: str, start: str = "start", end: str = "end", gap: int = 1) -> DataFrame:
    """(key, start, end): windows that overlap or lie within ``gap`` become one."""
    before = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(before.rowsBetween(W.unboundedPreceding, -1))
    d = windows.withColumn("fresh", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    d = d.withColumn("island", F.sum("fresh").over(before.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def ranges(points: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, start, end): runs of consecutive positions."""
    d = points.select(key, pos).distinct()
    d = d.withColumn("island", F.col(pos) - F.row_number().over(W.partitionBy(key).orderBy(pos)))
    return d.groupBy(key, "island").agg(F.min(pos).alias("start"), F.max(pos).alias("end")).drop("island")


def indent_segments(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``lines`` (key, pos, line) with ``segment``: a new one where the indent changes or after a blank line."""
    indent = F.length("line") - F.length(F.ltrim("line"))
    blank = F.trim("line") == ""
    w = W.partitionBy(key).orderBy("pos")
    d = lines.withColumns({"indent": indent, "blank": blank})
    fresh = F.coalesce((F.col("indent") != F.lag("indent").over(w)) | F.lag("blank").over(w), F.lit(False))
    return d.withColumn("fresh", fresh.cast("int")).withColumn("segment", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))


def score_blocks(blocks: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, score): 10 for each changed line, 0.5 for each line of control flow, 3 for a changed neighbour on either side of an unchanged block.

    ``blocks`` has (key, block, pos, control), a row per line; ``hits`` has (key, pos)."""
    changed = hits.select(key, "pos").distinct().withColumn("hit", F.lit(1))
    b = blocks.join(changed, [key, "pos"], "left").groupBy(key, "block").agg(F.count("hit").alias("hits"), F.count_if("control").alias("control"))
    w = W.partitionBy(key).orderBy("block")
    beside = F.coalesce((F.lag("hits").over(w) > 0).cast("int"), F.lit(0)) + F.coalesce((F.lead("hits").over(w) > 0).cast("int"), F.lit(0))
    return b.select(key, "block", (10.0 * F.col("hits") + 0.5 * F.col("control") + F.when(F.col("hits") == 0, 3.0 * beside).otherwise(0.0)).alias("score"))


def merge_candidates(parts: list[DataFrame]) -> DataFrame:
    """Union of candidates (id, relevance, ord, signature, code) with one row per id: the highest relevance, the least order, the first code and signature there is."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.max("relevance").alias("relevance"), F.min("ord").alias("ord"), F.min_by("signature", F.when(F.col("signature").isNotNull(), F.col("ord"))).alias("signature"), F.min_by("code", F.when(F.col("code").isNotNull(), F.col("ord"))).alias("code"))


def edited_signatures(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, kind): symbols whose signature was added, removed or changed; both sides have (name, signature)."""
    j = old.withColumnRenamed("signature", "o").join(new.withColumnRenamed("signature", "n"), "name", "full_outer")
    return j.filter(~F.col("o").eqNullSafe(F.col("n"))).select("name", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed").alias("kind"))


def paired_grid(tasks: DataFrame, repeats: int, cells: DataFrame) -> DataFrame:
    """(task, repeat, baseline, adaptive, state) over the whole grid; ``cells`` has (task, repeat, condition, value). More than one row of a cell is an error, none leaves the pair incomplete."""
    grid = tasks.select("task").distinct().select("task", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    by = cells.groupBy("task", "repeat").agg(*[x for c in ("baseline", "adaptive") for x in (F.count_if(F.col("condition") == c).alias(f"n_{c}"), F.max(F.when(F.col("condition") == c, F.col("value"))).alias(c))])
    j = grid.join(by, ["task", "repeat"], "left")
    state = F.when((F.col("n_baseline") > 1) | (F.col("n_adaptive") > 1), "duplicate").when((F.col("n_baseline") == 1) & (F.col("n_adaptive") == 1), "complete").otherwise("incomplete")
    return j.select("task", F.col("repeat").cast("long").alias("repeat"), "baseline", "adaptive", state.alias("state"))
