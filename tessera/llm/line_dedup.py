"""Line dedup: drop the lines that many documents share, keep one holder's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, ascii_lower, key128, stored

#: A key that at least 1/HOT of all records have is hot; there are HOT of them at most.
HOT = 2000


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text_col`` rewritten and ``n_lines``, ``n_dropped`` (before and by dropping) added.

    A line's key is the line stripped of ASCII white space with A-Z in lower
    case. A key of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold loses its lines everywhere but in the document
    with the largest id that holds it. DataFrame functions only:

    1. one scan turns each text into 128-bit keys of its long lines, by position;
    2. the distinct ids of each key are counted: first by (key, id), which deals
       a hot key evenly, then by key with map-side combine;
    3. the narrow (row, position, key) records meet the common keys. Hot keys,
       2 000 at most by definition, are broadcast; all others are joined
       by a shuffle in which no key has more than 1/2000 of the records;
    4. the positions to drop meet the rows, whose texts are joined anew.

    Rows that share an id are one document: they count once, and all keep or
    lose a line alike. Null ids are one document, ranked below all others. Null
    text counts as empty (one empty line). Of repeated lines in a row, all stay or go. Very
    long texts and lines are read whole. An empty table gives an empty result. Other columns
    stay; the helper columns are named ``__ld_*``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = key128(F.col(id_col), text)
    lines = F.split(text, "\n", -1)

    def hashed(key):
        a, b = key128(key)
        return F.when(key.isNotNull(), F.struct(a.alias("a"), b.alias("b")))

    # step by step, as nothing inside one function is shared: each line is stripped, lowered and hashed once
    stripped = F.transform(lines, lambda x: F.btrim(x, F.lit(WS_CHARS)))
    keys = F.transform(F.transform(stripped, lambda x: F.when(F.length(x) >= min_chars, ascii_lower(x))), hashed)
    rows = stored(docs.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).alias("id"), keys.alias("keys")), "lines")
    # a null id is told apart by a flag, so that it counts as a document
    records = rows.select("k1", "k2", F.col("id").isNotNull().alias("named"), "id", F.posexplode("keys").alias("pos", "key")).filter(F.col("key").isNotNull())
    records = records.select("k1", "k2", "named", "id", "pos", "key.a", "key.b")
    held = records.groupBy("a", "b", "named", "id").agg(F.count("*").alias("m"))
    common = held.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.max("id").alias("holder")).filter(F.col("n") >= min_docs)
    common = stored(common.select("a", "b", "m", "holder"), "common-lines")
    every = rows.agg(F.sum(F.size(F.filter("keys", lambda x: x.isNotNull())))).first()[0] or 0
    hot = common.filter(F.col("m") * HOT >= every).drop("m").withColumn("hot", F.lit(True))
    marked = records.join(F.broadcast(hot), ["a", "b"], "left")
    gone = (F.col("id") < F.col("holder")) | (F.col("id").isNull() & F.col("holder").isNotNull())
    cold = marked.filter("hot is null").drop("hot", "holder").join(common.filter(F.col("m") * HOT < every).drop("m"), ["a", "b"])
    drops = marked.filter("hot").filter(gone).select("k1", "k2", "pos").unionByName(cold.filter(gone).select("k1", "k2", "pos"))
    drops = drops.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("__ld_pos")).withColumnsRenamed({"k1": "__ld_1", "k2": "__ld_2"})
    met = docs.withColumns({"__ld_1": k1, "__ld_2": k2}).join(drops, ["__ld_1", "__ld_2"], "left")
    met = met.withColumns({"__ld_lines": lines, "__ld_pos": F.coalesce("__ld_pos", F.array().cast("array<int>"))})
    # the runs of lines between two dropped positions
    fenced = met.withColumn("__ld_pos", F.concat(F.array(F.lit(-1)), "__ld_pos", F.array(F.size("__ld_lines"))))
    runs = F.transform(F.sequence(F.lit(1), F.size("__ld_pos") - 1), lambda i: F.slice("__ld_lines", F.get("__ld_pos", i - 1) + 2, F.get("__ld_pos", i) - F.get("__ld_pos", i - 1) - 1))
    return fenced.withColumns({
        text_col: F.when(F.size("__ld_pos") == 2, text).otherwise(F.array_join(F.flatten(runs), "\n")),
        "n_lines": F.size("__ld_lines").cast("long"),
        "n_dropped": (F.size("__ld_pos") - 2).cast("long"),
    }).drop("__ld_1", "__ld_2", "__ld_lines", "__ld_pos")
