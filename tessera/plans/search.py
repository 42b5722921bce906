"""Search queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import code_tokens, normalised
from tessera.operators import search as S
from tessera.registry import query
from tessera.standins import LINES, TOKENS, lines, table, texts

TERMS = ["license", "version", "token", "the", "license"]
_TOK = TOKENS.format("text")
_IN = "('license','version','token','the')"
_BM25 = f"""toks AS (SELECT doc_id, {_TOK} AS t FROM documents),
 stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
 tf AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM toks, (VALUES ('license'),('version'),('token'),('the')) q(term)),
 df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
 raw AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df, stats),
 idf AS (SELECT term, CASE WHEN df = 0 THEN 0 WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw WHERE df > 0) ELSE raw END AS idf FROM raw),
 bm25 AS (SELECT doc_id, round(sum((CASE WHEN term = 'license' THEN 2.0 ELSE 1.0 END) * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 8) AS score FROM tf JOIN idf USING (term), stats WHERE tf > 0 GROUP BY doc_id HAVING round(sum((CASE WHEN term = 'license' THEN 2.0 ELSE 1.0 END) * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 8) > 0)"""
_BM25_TOP = "SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT {k})"
_COS = """units AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 unit AS (SELECT vec_id, label, list_transform(e, lambda x: CASE WHEN sqrt(list_inner_product(e, e)) > 0 THEN x / sqrt(list_inner_product(e, e)) ELSE x END) AS u FROM units),
 cos AS (SELECT vec_id, label, round(list_inner_product(u, (SELECT u FROM unit WHERE vec_id = 0)), 8) AS score FROM unit),
 vec AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT * FROM cos ORDER BY score DESC, vec_id LIMIT {k}))"""


@query("fun_01_tokens", f"SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS n_tokens, md5(array_to_string({_TOK}, ' ')) AS digest FROM documents")
def fun_01(spark: SparkSession, sf: str) -> DataFrame:
    t = code_tokens(F.col("text"))
    return texts(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("agg_14_bm25_build", f"SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term")
def agg_14(spark: SparkSession, sf: str) -> DataFrame:
    return S.term_stats(texts(spark, sf), "doc_id", "text")


@query("agg_14_postings", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY doc_id, term")
def agg_14_postings(spark: SparkSession, sf: str) -> DataFrame:
    return S.postings(texts(spark, sf), "doc_id", "text")


@query("agg_15_bm25", f"WITH {_BM25} {_BM25_TOP.format(k=20)}")
def agg_15(spark: SparkSession, sf: str) -> DataFrame:
    return S.bm25(texts(spark, sf), TERMS, k=20)


_IDF = f"""{LINES}, own AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(terms) AS term FROM v_lines) WHERE term IN {_IN}),
 idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(DISTINCT doc_id) FROM own)) / (1.0 + count(*))) + 1 AS idf FROM own GROUP BY term)"""


@query("agg_13_idf", f"WITH {_IDF} SELECT term, df, round(idf, 8) AS idf FROM idf")
def agg_13(spark: SparkSession, sf: str) -> DataFrame:
    return S.idf(S.line_hits(texts(spark, sf), TERMS)).select("term", "df", F.round("idf", 8).alias("idf"))


_WIN = f"""{_IDF}, hit AS (SELECT DISTINCT doc_id, pos, term FROM (SELECT doc_id, pos, unnest(terms) AS term FROM v_lines) WHERE term IN {_IN}),
 ends AS (SELECT doc_id, max(pos) AS n_lines FROM v_lines GROUP BY doc_id),
 near AS (SELECT DISTINCT l.doc_id, l.pos, h.term FROM v_lines l JOIN hit h ON h.doc_id = l.doc_id AND h.pos BETWEEN l.pos - 12 AND l.pos + 12),
 scored AS (SELECT doc_id, pos, round(sum(idf), 8) AS score FROM near JOIN idf USING (term) GROUP BY doc_id, pos),
 win AS (SELECT doc_id, greatest(1, pos - 12) AS "start", least(n_lines, pos + 12) AS "end", score FROM scored JOIN ends USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) = 1)"""


@query("win_05_best_window", f"WITH {_WIN} SELECT * FROM win")
def win_05(spark: SparkSession, sf: str) -> DataFrame:
    return S.best_windows(S.line_hits(texts(spark, sf), TERMS))


@query("top_07_excerpts", f"""WITH {_WIN} SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM win ORDER BY score DESC, doc_id LIMIT 25)""")
def top_07(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the best excerpts of the corpus for a task's terms."""
    return S.ranked(S.best_windows(S.line_hits(texts(spark, sf), TERMS)), "doc_id", 25)


@query("top_08_decision", f"""WITH {_WIN}, r AS (SELECT score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM win),
 t AS (SELECT max(score) FILTER (rank = 1) AS first, max(score) FILTER (rank = 2) AS second FROM r),
 c AS (SELECT *, CASE WHEN first IS NULL THEN 0.0 WHEN second IS NULL THEN 0.75 ELSE least(0.9, 0.5 + (first - second) / first) END AS sure FROM t)
 SELECT first, second, round(CAST(sure AS DOUBLE), 8) AS confidence, CASE WHEN sure >= 0.6 THEN 'provide' WHEN first IS NULL THEN 'skip' ELSE 'offer' END AS decision FROM c""")
def top_08(spark: SparkSession, sf: str) -> DataFrame:
    return S.decision(S.ranked(S.best_windows(S.line_hits(texts(spark, sf), TERMS)), "doc_id", 2))


@query("prj_05_line_search", f"""WITH {LINES}, c AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM v_lines)
 SELECT doc_id, pos, line, context FROM c WHERE regexp_matches(line, 'Licen[sc]e|token =') ORDER BY doc_id, pos LIMIT 100""")
def prj_05(spark: SparkSession, sf: str) -> DataFrame:
    return S.line_search(texts(spark, sf), "Licen[sc]e|token =", "doc_id")


def _vectors(spark: SparkSession, sf: str, k: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("__q"))
    near = e.crossJoin(F.broadcast(q.limit(1)))
    return S.vector_top(near, F.col("__q"), k=k)


@query("jon_21_vector_top", f"WITH {_COS.format(k=20)} SELECT * FROM vec")
def jon_21(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf, 20)


@query("jon_22_max_sim", """WITH u AS (SELECT vec_id, list_transform(range(0, 8), lambda i: CAST(embedding AS DOUBLE[])[i * 8 + 1 : i * 8 + 8]) AS tokens FROM embeddings),
 q AS (SELECT unnest(tokens) AS q, generate_subscripts(tokens, 1) AS n FROM u WHERE vec_id = 0),
 best AS (SELECT vec_id, n, list_max(list_transform(tokens, lambda t: list_inner_product(t, q))) AS best FROM u, q),
 s AS (SELECT vec_id, round(sum(best), 6) AS score FROM best GROUP BY vec_id)
 SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10)""")
def jon_22(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    u = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8)).alias("tokens"))
    first = u.filter("vec_id = 0").limit(1).first()
    top = S.max_sim(u, first["tokens"] if first else [[0.0] * 8], k=10)
    return top.withColumn("score", F.round("score", 6))


@query("jon_23_rrf", f"""WITH {_BM25}, {_COS.format(k=50)}, b AS ({_BM25_TOP.format(k=50)}),
 every AS (SELECT doc_id AS id, rank FROM b UNION ALL SELECT vec_id, rank FROM vec), f AS (SELECT id, round(sum(1.0 / (60 + rank)), 8) AS score FROM every GROUP BY id)
 SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM f ORDER BY score DESC, id LIMIT 20)""")
def jon_23(spark: SparkSession, sf: str) -> DataFrame:
    b = S.bm25(texts(spark, sf), TERMS, k=50).withColumnRenamed("doc_id", "id")
    return S.rrf([b, _vectors(spark, sf, 50).withColumnRenamed("vec_id", "id")], "id", 20)


@query("jon_24_hybrid", f"""WITH {_COS.format(k=50)}, x AS (SELECT vec_id, label AS name, 1.0::DOUBLE AS score FROM embeddings WHERE label = 3),
 s AS (SELECT v.vec_id, e.label AS name, v.score FROM vec v JOIN embeddings e USING (vec_id) WHERE e.label NOT IN (SELECT name FROM x)),
 a AS (SELECT *, 0 AS stage FROM x UNION ALL SELECT *, 1 FROM s) SELECT vec_id, name, score, row_number() OVER (ORDER BY stage, score DESC, vec_id) AS rank FROM a""")
def jon_24(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("name"))
    exact = e.filter("name = 3").withColumn("score", F.lit(1.0))
    semantic = _vectors(spark, sf, 50).join(e, "vec_id").select("vec_id", "name", "score")
    out = S.hybrid(exact, semantic, "vec_id", "name")
    return out.select("vec_id", "name", "score", "rank")


@query("agg_25_mrr", f"""WITH {_COS.format(k=20)}, t AS (SELECT label AS query_id, vec_id AS id FROM embeddings), r AS (SELECT (SELECT label FROM embeddings WHERE vec_id = 0) AS query_id, vec_id AS id, rank FROM vec),
 b AS (SELECT t.query_id, min(rank) AS rank FROM t LEFT JOIN r USING (query_id, id) GROUP BY t.query_id)
 SELECT count(*) AS n, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 8) AS hit_rate, round(avg(coalesce(1.0 / rank, 0)), 8) AS mrr FROM b""")
def agg_25(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    own = e.filter("vec_id = 0").select(F.col("label").alias("query_id")).limit(1)
    r = _vectors(spark, sf, 20).crossJoin(F.broadcast(own)).select("query_id", F.col("vec_id").alias("id"), "rank")
    return S.search_quality(r, e.select(F.col("label").alias("query_id"), F.col("vec_id").alias("id")))


@query("fun_11_normalise", """SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: (x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) ** 2)), 8) AS norm,
 round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 8) AS first FROM embeddings""")
def fun_11(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "embeddings").select("vec_id", normalised(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 8).alias("norm"), F.round(F.get("u", F.lit(0)), 8).alias("first"))
