"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_OP3 = r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""

_OP4 = """WITH b AS (SELECT coalesce(source, '') AS s, CAST(sum(strlen(coalesce(text, '')) + 1) AS DOUBLE) AS b FROM documents GROUP BY 1),
g AS (SELECT CAST(sum(CAST(round(pow(b, 0.5), 6) AS DECIMAL(38, 6))) AS DOUBLE) AS z, sum(b) AS every FROM b),
r AS (SELECT s, round(pow(b, 0.5), 6) / z * every / b AS mean FROM b, g),
u AS (SELECT doc_id, source, text, mean, (CAST('0x' || substring(md5('mix:' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents JOIN r ON s = coalesce(source, '')),
p AS (SELECT s, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c FROM r, range(0, 60) t(k)),
n AS (SELECT doc_id, source, text, mean, count(p.k) AS n_copies FROM u JOIN p ON p.s = coalesce(source, '') AND p.c < u.u GROUP BY ALL)
SELECT doc_id, source, n_copies, c.k AS copy, round(mean, 6) AS mean_rate, round((CAST('0x' || substring(md5('mix-order:' || doc_id || ':' || c.k), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0, 12) AS shuffle_key, md5(coalesce(text, '')) AS text_md5
FROM n, range(1, 60) c(k) WHERE c.k <= n_copies"""

_OP7 = """WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s, range(1, len(ls) + 1) r(i)),
h AS (SELECT key, max(doc_id) AS m FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT doc_id, i, line, coalesce(doc_id < m, FALSE) AS gone FROM l LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM x GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": _OP3, "op4_source_mixing": _OP4, "op7_line_dedup": _OP7}
