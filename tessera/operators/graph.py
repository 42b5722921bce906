"""Bounded and unbounded traversals of edge tables (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import cut


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(reversed_edges(edges.select("src", "dst"))).distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth, parent): nodes within ``depth`` steps of ``starts`` (node), each at its least depth with its least parent.

    One join per level. A level is made distinct and freed of nodes seen
    before, so the work is bounded by the edges and not by the paths. Each
    level is written before the next, which keeps plans short.
    """
    null = F.lit(None).cast(starts.schema["node"].dataType)
    levels = [starts.select("node", F.lit(0).cast("long").alias("depth"), null.alias("parent")).dropDuplicates(["node"])]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels)
        step = levels[-1].select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.lit(d).cast("long").alias("depth"), F.min("src").alias("parent"))
        levels.append(cut(step.join(seen.select("node"), "node", "left_anti").select("node", "depth", "parent"), "level"))
    return reduce(DataFrame.unionByName, levels)


def closure(edges: DataFrame, starts: DataFrame, most: int = 200) -> DataFrame:
    """(node, depth) of all nodes reachable from ``starts``, until a level is empty."""
    levels = [starts.select("node", F.lit(0).cast("long").alias("depth")).dropDuplicates(["node"])]
    for d in range(1, most + 1):
        seen = reduce(DataFrame.unionByName, levels)
        step = levels[-1].select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        level = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d).cast("long")), "level")
        if level.isEmpty():
            return seen
        levels.append(level)
    raise RuntimeError(f"closure: not complete after {most} levels")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in): one aggregation over both ends."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def layers(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, layer): entry points call and aren't called, leaves the other way round, the rest is middle."""
    d = degrees(edges)
    return d.withColumn("layer", F.when(F.col("n_in") == 0, "entry").when(F.col("n_out") == 0, "leaf").otherwise("middle"))


def dead(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node) that neither call nor are called; entry-like ones are the caller's to exclude."""
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def group_calls(edges: DataFrame, group: DataFrame) -> DataFrame:
    """(src_group, dst_group, calls) across groups; ``group`` has (node, grp)."""
    a = group.select(F.col("node").alias("src"), F.col("grp").alias("src_group"))
    b = group.select(F.col("node").alias("dst"), F.col("grp").alias("dst_group"))
    return edges.join(a, "src").join(b, "dst").filter("src_group <> dst_group").groupBy("src_group", "dst_group").agg(F.count("*").alias("calls"))


def group_layers(calls: DataFrame) -> DataFrame:
    """(grp, n_out, n_in, level): HIGH calls out at least twice as much as it is called, LOW the reverse, else MIDDLE."""
    d = calls.select(F.col("src_group").alias("grp"), F.col("calls").alias("o"), F.lit(0).cast("long").alias("i")).unionByName(calls.select(F.col("dst_group").alias("grp"), F.lit(0).cast("long").alias("o"), F.col("calls").alias("i")))
    d = d.groupBy("grp").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return d.withColumn("level", F.when(F.col("n_out") >= 2 * F.col("n_in"), "HIGH").when(F.col("n_in") >= 2 * F.col("n_out"), "LOW").otherwise("MIDDLE"))


def mutual(calls: DataFrame) -> DataFrame:
    """(a, b) with a < b that call each other."""
    other = calls.select(F.col("src_group").alias("b"), F.col("dst_group").alias("a"))
    return calls.select(F.col("src_group").alias("a"), F.col("dst_group").alias("b")).filter("a < b").join(other, ["a", "b"]).distinct()


def neighbourhood(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, relation): changed nodes, their callees, their callers; the first relation in this order wins."""
    own = changed.select("node", F.lit(0).alias("p"))
    callees = edges.join(changed.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"), F.lit(1).alias("p"))
    callers = edges.join(changed.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), F.lit(2).alias("p"))
    names = F.element_at(F.array(F.lit("changed"), F.lit("callee"), F.lit("caller")), F.min("p") + 1)
    return own.unionByName(callees).unionByName(callers).groupBy("node").agg(names.alias("relation"))


def adjacency(edges: DataFrame, most: int = 5) -> DataFrame:
    """(node, n_callees, callees, callers): the first ``most`` of either, sorted."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_callees"), F.slice(F.array_sort(F.collect_set("dst")), 1, most).alias("callees"))
    inn = edges.groupBy(F.col("dst").alias("node")).agg(F.slice(F.array_sort(F.collect_set("src")), 1, most).alias("callers"))
    return out.join(inn, "node", "full_outer").select("node", F.coalesce("n_callees", F.lit(0)).alias("n_callees"), "callees", "callers")


def ready_steps(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Steps (step, depends_on) that aren't done and whose dependencies all are."""
    open_ = steps.join(done.select("step"), "step", "left_anti")
    waiting = open_.select("step", F.explode("depends_on").alias("need")).join(done.select(F.col("step").alias("need")), "need", "left_anti").select("step").distinct()
    return open_.join(waiting, "step", "left_anti")


def ancestry(stacks: DataFrame, of: DataFrame, most: int = 200) -> DataFrame:
    """(node, depth): a version and its ancestors by parent pointers (stack_id, parent_id)."""
    up = stacks.filter("parent_id is not null").select(F.col("stack_id").alias("src"), F.col("parent_id").alias("dst"))
    return closure(up, of, most)


def supersession_conflicts(decisions: DataFrame) -> DataFrame:
    """(id, n): decisions (id, superseded_by) that more than one other replaces."""
    return decisions.filter("superseded_by is not null").groupBy("id").agg(F.countDistinct("superseded_by").alias("n")).filter("n > 1")


def supersession(decisions: DataFrame, starts: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(first, current, steps): the last decision of the chain from each start (id) by links (id, superseded_by), and the links up to it.

    A link whose target isn't there ends its chain before it. Pointers are
    doubled, so the rounds grow with the logarithm of the longest chain.
    Raises for a decision that is replaced twice, and for a cycle.
    """
    links = cut(decisions.select("id", "superseded_by").distinct(), "decisions")
    twice = supersession_conflicts(links).first()
    if twice:
        raise ValueError(f"decision {twice['id']} is superseded by {twice['n']} others")
    there = links.select(F.col("id").alias("superseded_by")).distinct()
    jump = cut(links.join(there, "superseded_by").select("id", F.col("superseded_by").alias("to"), F.lit(1).cast("long").alias("steps")), "jumps")
    for _ in range(most_rounds):
        more = jump.select(F.col("id").alias("to"), F.col("to").alias("end"), F.col("steps").alias("further"))
        if jump.join(more, "to", "left_semi").isEmpty():
            own = starts.select("id").distinct().join(there, F.col("id") == F.col("superseded_by"), "left_semi")
            return own.join(jump, "id", "left").select(F.col("id").alias("first"), F.coalesce("to", "id").alias("current"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps"))
        jump = cut(jump.join(more, "to", "left").select("id", F.coalesce("end", "to").alias("to"), (F.col("steps") + F.coalesce("further", F.lit(0))).alias("steps")), "jumps")
    raise RuntimeError(f"supersession: a cycle, or not complete after {most_rounds} rounds")


def visible_edges(log: DataFrame, chain: DataFrame) -> DataFrame:
    """Edges of a layered log (stack_id, op, edge_id, payload...) as seen from a chain (node, depth): the newest layer with an entry for an edge decides."""
    own = log.join(chain.select(F.col("node").alias("stack_id"), "depth"), "stack_id")
    last = own.groupBy("edge_id").agg(F.min_by("op", F.struct("depth", F.when(F.col("op") == "delete", 0).otherwise(1))).alias("op"), F.min("depth").alias("depth"))
    return last.filter("op = 'add'").select("edge_id", "depth")
