"""Evaluation statistics over orders as outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import statistics as S
from tessera.operators.relational import paired_grid
from tessera.registry import query
from tessera.standins import OUTCOMES, outcomes, table


@query("agg_17_variants", f"""WITH {OUTCOMES} SELECT variant, count(*) AS n, round(avg(success::INT::DOUBLE), 8) AS success_rate, round(avg(tokens), 4) AS mean, round(median(tokens), 4) AS median, round(CASE WHEN count(*) > 1 THEN stddev_samp(tokens) ELSE 0 END, 4) AS deviation, round(avg(CASE WHEN tokens > 0 THEN 500000 / tokens END), 6) AS ratio FROM v_outcomes GROUP BY variant""")
def agg_17(spark: SparkSession, sf: str) -> DataFrame:
    return S.variant_stats(outcomes(spark, sf), F.lit(500000.0))


@query("agg_18_pearson", "WITH a AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT n, round(r, 8) AS r, round(least(1.0, 2 * exp(-(r * r * (n - 2) / (1 - r * r)) / 2)), 8) AS p FROM a")
def agg_18(spark: SparkSession, sf: str) -> DataFrame:
    return S.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("agg_19_spearman", "WITH r AS (SELECT o_orderpriority AS variant, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)::DOUBLE AS rx, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)::DOUBLE AS ry FROM orders) SELECT variant, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM r GROUP BY variant")
def agg_19(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "variant")
    return S.spearman(o, "o_totalprice", "o_orderdate", "o_orderkey", "variant")


@query("agg_20_two_proportions", f"""WITH {OUTCOMES}, a AS (SELECT count(*) FILTER (success AND variant LIKE '1%') AS a, count(*) FILTER (variant LIKE '1%') AS na, count(*) FILTER (success AND variant LIKE '5%') AS b, count(*) FILTER (variant LIKE '5%') AS nb FROM v_outcomes), p AS (SELECT a / na AS p, b / nb AS q, na, nb FROM a)
 SELECT round(p - q, 8) AS difference, round(p - q - 1.96 * sqrt(p * (1 - p) / na + q * (1 - q) / nb), 8) AS low, round(p - q + 1.96 * sqrt(p * (1 - p) / na + q * (1 - q) / nb), 8) AS high FROM p""")
def agg_20(spark: SparkSession, sf: str) -> DataFrame:
    one, five = F.col("variant").startswith("1"), F.col("variant").startswith("5")
    a = outcomes(spark, sf).agg(F.count_if(F.col("success") & one).alias("a"), F.count_if(one).alias("na"), F.count_if(F.col("success") & five).alias("b"), F.count_if(five).alias("nb"))
    d, low, high = S.two_proportions(*[F.col(c) for c in ("a", "na", "b", "nb")])
    return a.select(d.alias("difference"), low.alias("low"), high.alias("high"))


@query("agg_21_bootstrap", """WITH v AS (SELECT s_acctbal AS v, row_number() OVER (ORDER BY s_acctbal) - 1 AS i FROM supplier), n AS (SELECT count(*) AS n FROM v), d AS (SELECT s, CAST('0x' || substring(md5('42:' || s || ':' || d), 1, 8) AS BIGINT) % n AS i FROM n, range(0, 200) a(s), range(0, (SELECT n FROM n)) b(d)),
 m AS (SELECT s, median(v) AS m FROM d JOIN v USING (i) GROUP BY s), l AS (SELECT list_sort(list(m)) AS m FROM m) SELECT n, round(m[6], 8) AS low, round(m[196], 8) AS high FROM l, n""")
def agg_21(spark: SparkSession, sf: str) -> DataFrame:
    return S.bootstrap_median(table(spark, sf, "supplier"), "s_acctbal", 200)


_PAIRS = """c AS (SELECT o_custkey AS task, o_orderkey % 3 + 1 AS repeat, CASE WHEN o_orderstatus = 'F' THEN 'baseline' ELSE 'adaptive' END AS condition, o_totalprice AS value FROM orders), g AS (SELECT DISTINCT task, r AS repeat FROM c, range(1, 4) t(r)),
 b AS (SELECT task, repeat, count(*) FILTER (condition = 'baseline') AS nb, max(value) FILTER (condition = 'baseline') AS baseline, count(*) FILTER (condition = 'adaptive') AS na, max(value) FILTER (condition = 'adaptive') AS adaptive FROM c GROUP BY ALL),
 p AS (SELECT baseline, adaptive, CASE WHEN nb > 1 OR na > 1 THEN 'duplicate' WHEN nb = 1 AND na = 1 THEN 'complete' ELSE 'incomplete' END AS state FROM g LEFT JOIN b ON b.task = g.task AND b.repeat = g.repeat)"""


@query("agg_22_gate", f"""WITH {_PAIRS}, s AS (SELECT state, CASE WHEN state = 'complete' AND baseline > 0 THEN 1 - adaptive / baseline END AS s FROM p), a AS (SELECT count(*) FILTER (state = 'complete') AS pairs, count(*) FILTER (state = 'duplicate') AS failures, median(s) AS saving, count(*) FILTER (s >= 0.2) AS wins, count(*) FILTER (s < -0.05) AS losses FROM s)
 SELECT pairs, failures, round(saving, 8) AS saving, wins, losses, CASE WHEN pairs = 0 THEN 'inconclusive' WHEN saving >= 0.2 THEN 'pass' ELSE 'fail' END AS verdict FROM a""")
def agg_22(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 3 + 1).alias("repeat"), F.when(F.col("o_orderstatus") == "F", "baseline").otherwise("adaptive").alias("condition"), F.col("o_totalprice").alias("value"))
    return S.gate(paired_grid(o, 3, o), 0.2, 0.05)


@query("agg_23_shared_savings", "WITH a AS (SELECT o_custkey AS t, sum(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS t, sum(o_totalprice) AS y FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT count(*) AS tasks, round(sum(x), 2) AS baseline, round(sum(y), 2) AS variant, round(100 * (1 - sum(y) / sum(x)), 4) AS saved FROM a JOIN b USING (t)")
def agg_23(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("x"), F.sum(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))).alias("y")).filter("x is not null and y is not null")
    return o.agg(F.count("*").alias("tasks"), F.round(F.sum("x"), 2).alias("baseline"), F.round(F.sum("y"), 2).alias("variant"), F.round(100 * (1 - F.sum("y") / F.nullif(F.sum("x"), F.lit(0.0))), 4).alias("saved"))


@query("agg_24_medians", "SELECT event_type, round(median(coalesce(value, 0)), 8) AS median FROM events GROUP BY event_type")
def agg_24(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.median(F.coalesce("value", F.lit(0.0))), 8).alias("median"))


@query("agg_16_context_metrics", "SELECT source, count(*) AS symbols, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(greatest(1, floor(length(text) / 4))) AS BIGINT) AS tokens, round(avg(least(1.0, length(text) / 4000.0)), 8) AS fill, count(*) FILTER (greatest(1, floor(length(text) / 4)) <= 500) AS within FROM documents GROUP BY source")
def agg_16(spark: SparkSession, sf: str) -> DataFrame:
    n = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("symbols"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(n).alias("tokens"), F.round(F.avg(F.least(F.lit(1.0), F.length("text") / 4000.0)), 8).alias("fill"), F.count_if(n <= 500).alias("within"))


@query("jon_26_baseline_variant", "WITH l AS (SELECT o_custkey AS task, o_orderstatus AS s, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY ALL) SELECT a.task AS task, a.v AS baseline, b.v AS variant FROM l a JOIN l b ON a.task = b.task WHERE a.s = 'F' AND b.s = 'O'")
def jon_26(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("task")).agg(*[F.max_by(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")), F.when(F.col("o_orderstatus") == s, F.col("o_orderkey"))).alias(c) for s, c in (("F", "baseline"), ("O", "variant"))])
    return last.filter("baseline is not null and variant is not null")
