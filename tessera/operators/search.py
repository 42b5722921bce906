"""Lexical, vector and fused search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import code_tokens, dot, normalised
from tessera.shared import cut

K1, B, RRF = 1.5, 0.75, 60


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): one shuffle on (id, term), combined on the map side."""
    return docs.select(id_col, F.explode(code_tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, df (documents), cf (occurrences). Terms are made distinct inside the row, so one shuffle does."""
    t = code_tokens(F.col(text_col))
    both = docs.select(F.explode(t).alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d")).unionByName(docs.select(F.explode(F.array_distinct(t)).alias("term"), F.lit(0).alias("c"), F.lit(1).alias("d")))
    return both.groupBy("term").agg(F.sum("d").alias("df"), F.sum("c").alias("cf"))


def query_hits(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, dl, term, tf) of the distinct query terms. Counts are taken inside the row, in one pass over the text that is written before its rows are used again; no text is shuffled."""
    asked = F.array(*[F.lit(t) for t in sorted(set(terms))])
    d = docs.select(id_col, code_tokens(F.col(text_col)).alias("tokens"))
    d = cut(d.select(id_col, F.size("tokens").cast("long").alias("dl"), F.filter("tokens", lambda t: F.array_contains(asked, t)).alias("own")), "hits")
    d = d.select(id_col, "dl", F.explode(asked).alias("term"), "own")
    return d.select(id_col, "dl", "term", F.size(F.filter("own", lambda t: t == F.col("term"))).cast("long").alias("tf"))


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", k: int | None = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score, rank): Okapi BM25, a repeated query term counting as often; only scores above 0.

    Statistics of the corpus are one row per query term, broadcast. The floor
    for terms of negative IDF is a quarter of the mean IDF of the query's terms.
    """
    hits = query_hits(docs, terms, id_col, text_col)
    per = len(set(terms))
    n = hits.agg((F.count("*") / per).alias("n"), F.avg("dl").alias("avgdl"))
    df = hits.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    idf = df.crossJoin(n).withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.filter("df > 0").agg(F.avg("raw").alias("mean"))
    idf = idf.crossJoin(mean).select("term", "avgdl", F.when(F.col("df") == 0, 0.0).when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    times = F.create_map(*[x for t in sorted(set(terms)) for x in (F.lit(t), F.lit(float(terms.count(t))))])
    weight = times[F.col("term")] * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.filter("tf > 0").join(F.broadcast(idf), "term").groupBy(id_col).agg(F.round(F.sum(weight), 8).alias("score")).filter("score > 0")
    return ranked(scored, id_col, k)


def ranked(scored: DataFrame, id_col: str, k: int | None) -> DataFrame:
    """The first k by score, then id, with their ranks. The limit comes first (a heap per task), so the numbering window sees k rows."""
    top = scored.orderBy(F.desc("score"), id_col)
    top = top.limit(k) if k else top
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), id_col)).cast("long"))


def vector_top(units: DataFrame, query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10) -> DataFrame:
    """(id, score, rank) of the k vectors nearest to a query vector (an array literal), by cosine: a scan and a heap per task."""
    return ranked(units.select(id_col, F.round(dot(normalised(F.col(vec_col)), normalised(query)), 8).alias("score")), id_col, k)


def literal_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def max_sim(units: DataFrame, query: list[list[float]], id_col: str = "vec_id", tokens_col: str = "tokens", k: int = 10) -> DataFrame:
    """Late interaction: for each query token the best dot product among a unit's tokens, summed."""
    def closest(q: Column) -> Column:
        return F.array_max(F.transform(tokens_col, lambda t: dot(t, q)))

    best = [closest(literal_vector(q)) for q in query]
    total = best[0]
    for x in best[1:]:
        total = total + x
    return ranked(units.select(id_col, F.round(total, 8).alias("score")), id_col, k)


def rrf(lists: list[DataFrame], id_col: str, k: int = 10, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank from 1): sum of 1 / (constant + rank)."""
    every = lists[0].select(id_col, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(id_col, "rank"))
    fused = every.groupBy(id_col).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"))
    return ranked(fused, id_col, k)


def hybrid(exact: DataFrame, semantic: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Exact hits first, then semantic ones whose name no exact hit has; ranked anew. Both come with (id, name, score)."""
    rest = semantic.join(exact.select(name_col).distinct(), name_col, "left_anti")
    every = exact.select(id_col, name_col, "score", F.lit(0).alias("stage")).unionByName(rest.select(id_col, name_col, "score", F.lit(1).alias("stage")))
    return every.withColumn("rank", F.row_number().over(W.orderBy("stage", F.desc("score"), id_col)).cast("long"))


def search_quality(results: DataFrame, truth: DataFrame, query_col: str = "query_id", id_col: str = "id") -> DataFrame:
    """hit_rate and mrr over the queries of ``truth`` (query, relevant id)."""
    best = truth.join(results, [query_col, id_col], "left").groupBy(query_col).agg(F.min("rank").alias("rank"))
    return best.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)), 8).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 8).alias("mrr"))


def line_hits(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, own): for each line of a document the query terms in it. One pass over the texts, written, as IDF and windows both read it."""
    asked = F.array(*[F.lit(t) for t in sorted(set(terms))])
    own = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.array_intersect(code_tokens(x), asked))
    return cut(docs.select(id_col, own.alias("own")), "line-hits")


def idf(hits: DataFrame) -> DataFrame:
    """(term, df, idf) over documents that hold any query term: ln((1 + N) / (1 + df)) + 1."""
    own = hits.select(F.array_distinct(F.flatten("own")).alias("t")).filter(F.size("t") > 0)
    n = own.agg(F.count("*").alias("n"))
    return own.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(n).select("term", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def best_windows(hits: DataFrame, id_col: str = "doc_id", reach: int = 12) -> DataFrame:
    """(id, start, end, score): of each document the first window of ``reach`` lines either way with the highest sum of IDF over its distinct query terms.

    ``hits`` is of ``line_hits``. The window slides inside the row, so nothing
    is shuffled but the counts for IDF, which come back as a broadcast map of a row per query term.
    """
    weights = idf(hits).agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("weights"))
    d = hits.filter(F.size(F.flatten("own")) > 0).crossJoin(F.broadcast(weights))

    def score(i: Column) -> Column:
        at = F.greatest(F.lit(1), i - reach)
        near = F.array_sort(F.array_distinct(F.flatten(F.slice("own", at, i + reach - at + 1))))
        return F.round(F.aggregate(near, F.lit(0.0), lambda s, t: s + F.element_at(F.col("weights"), t)), 8)

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("own")), lambda i: F.struct(score(i).alias("score"), (-i).alias("neg"))))
    d = d.select(id_col, F.size("own").alias("n_lines"), best.alias("best")).select(id_col, "n_lines", (-F.col("best.neg")).alias("pos"), "best.score")
    return d.select(id_col, F.greatest(F.lit(1), F.col("pos") - reach).cast("long").alias("start"), F.least("n_lines", F.col("pos") + reach).cast("long").alias("end"), "score")


def decision(ranked_hits: DataFrame) -> DataFrame:
    """One row: the best score, its lead over the second, a confidence of at most 0.9, and whether that is enough to act."""
    top = ranked_hits.filter("rank <= 2").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    lead = (F.col("first") - F.coalesce("second", F.lit(0.0))) / F.col("first")
    sure = F.when(F.col("first").isNull(), 0.0).when(F.col("second").isNull(), 0.75).otherwise(F.least(F.lit(0.9), 0.5 + lead))
    return top.select("first", "second", F.round(sure, 8).alias("confidence"), F.when(sure >= 0.6, "provide").when(F.col("first").isNull(), "skip").otherwise("offer").alias("decision"))


def line_search(docs: DataFrame, pattern: str, id_col: str, text_col: str = "text", context: int = 1, limit: int = 100) -> DataFrame:
    """(id, pos, line, context): lines that match a regular expression, with ``context`` lines either way, the first ``limit`` by document and position.

    Lines are matched inside the row, and only hits leave it; the limit keeps that many per task.
    """
    every = F.split(F.col(text_col), "\n")
    near = lambda i: F.array_join(F.slice("lines", F.greatest(F.lit(1), i + 1 - context), F.least(i, F.lit(context)) + 1 + context), "\n")
    found = F.filter(F.transform("lines", lambda x, i: F.when(F.rlike(x, F.lit(pattern)), F.struct((i + 1).cast("long").alias("pos"), x.alias("line"), near(i).alias("context")))), lambda h: h.isNotNull())
    hits = docs.select(id_col, every.alias("lines")).select(id_col, F.explode(found).alias("h"))
    return hits.select(id_col, "h.pos", "h.line", "h.context").orderBy(id_col, "pos").limit(limit)
