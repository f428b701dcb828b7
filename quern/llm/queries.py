"""The thin queries over the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, line_templates, packing, quality_rules, simhash, suffix_dedup, token_counts, vector_approximation, warc
from .common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scores(documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(documents(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repaired(documents(spark, sf_dir, "conversations"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digests(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_approximation.top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_warc, op3_chat_format, op4_token_counts, op5_line_templates,
        op6_best_fit_packing, op7_suffix_dedup, op8_top_k, op9_simhash, op10_byte_bpe,
    )
}

#: DuckDB SQL over the whole tables, where it is fast enough there.
ORACLES: dict[str, str] = {
    "op2_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), letters AS (
  SELECT sha, string_agg(array_to_string([('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + ((v >> s) & 31)] FOR s IN [15, 10, 5, 0]], ''), '' ORDER BY k) AS payload_digest
  FROM (SELECT sha, k, ('0x' || substr(sha, 5 * k + 1, 5))::INTEGER AS v FROM (SELECT DISTINCT sha FROM p), range(8) r(k)) GROUP BY sha
), heads AS (
  SELECT *, max(page_id) OVER (PARTITION BY sha) AS head FROM p JOIN letters USING (sha)
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to FROM heads""",
    "op5_line_templates": """
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, string_split(t, chr(10)) AS s FROM d)),
k AS (
  SELECT doc_id, n, regexp_split_to_array(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), '[\x09-\x0D ]+') AS k
  FROM l WHERE trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), f AS (
  SELECT doc_id, n, sig, f, len(f) || ' ' || array_to_string(f[1:2], ' ') AS leaf
  FROM (SELECT doc_id, n, array_to_string(k, ' ') AS sig, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN k] AS f FROM k)
), live AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5),
c AS (SELECT leaf, sig, any_value(f) AS f, count(DISTINCT doc_id) AS w FROM f WHERE leaf IN (FROM live) GROUP BY leaf, sig),
runs AS (SELECT leaf, sig, w, j, f[len(f) * j // g + 1 : len(f) * (j + 1) // g] AS run FROM (SELECT *, 3 * len(f) // 10 + 1 AS g, unnest(range(3 * len(f) // 10 + 1)) AS j FROM c WHERE len(f) >= 4)),
shared AS (SELECT leaf, j, run FROM runs GROUP BY ALL HAVING sum(w) >= 5),
held AS (SELECT DISTINCT leaf, sig FROM runs JOIN shared USING (leaf, j, run)),
e AS (SELECT leaf, sig, w, f[p] AS a, f[p + 1] AS b, p FROM (SELECT c.*, unnest(range(1, len(f))) AS p FROM c JOIN held USING (leaf, sig))),
ab AS (SELECT leaf, p, a, b, sum(w) AS n FROM e GROUP BY ALL),
na AS (SELECT leaf, p, a, sum(n) AS n FROM ab GROUP BY ALL HAVING sum(n) >= 5),
nb AS (SELECT leaf, p, b, sum(n) AS n FROM ab GROUP BY ALL HAVING sum(n) >= 5),
total AS (SELECT leaf, sum(w) AS n FROM c JOIN held USING (leaf, sig) GROUP BY leaf),
fixed AS (
  SELECT ab.leaf, ab.p, ab.a, ab.b, coalesce(ab.a <> '<*>' AND na.n IS NOT NULL AND (na.n >= 0.5 * total.n OR ab.n >= 0.5 * nb.n), false) AS fa,
         coalesce(ab.b <> '<*>' AND nb.n IS NOT NULL AND (nb.n >= 0.5 * total.n OR ab.n >= 0.5 * na.n), false) AS fb
  FROM ab JOIN total USING (leaf) LEFT JOIN na ON na.leaf = ab.leaf AND na.p = ab.p AND na.a = ab.a LEFT JOIN nb ON nb.leaf = ab.leaf AND nb.p = ab.p AND nb.b = ab.b
), marks AS (
  SELECT leaf, sig, e.p AS p, e.a AS token FROM e JOIN fixed USING (leaf, p, a, b) WHERE fa UNION SELECT leaf, sig, e.p + 1, e.b FROM e JOIN fixed USING (leaf, p, a, b) WHERE fb
), m AS (SELECT leaf, sig, count(*) AS n_held, string_agg(p || ':' || token, chr(10) ORDER BY p) AS part FROM marks GROUP BY leaf, sig),
t AS (
  SELECT leaf, sig, CASE WHEN n_held >= 3 AND 10 * n_held >= 7 * len([x FOR x IN f IF x <> '<*>']) THEN 'part ' || part || ' ' || array_to_string([CAST(x = '<*>' AS VARCHAR) FOR x IN f], ' ') ELSE 'whole ' || sig END AS template FROM c LEFT JOIN m USING (leaf, sig)
), u AS (SELECT doc_id, n, leaf, template FROM f JOIN t USING (leaf, sig)),
r AS (SELECT leaf, template, min(doc_id) AS first FROM u GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT u.doc_id, u.n FROM u JOIN r USING (leaf, template) WHERE u.doc_id <> first),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.n) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.n) FILTER (g.n IS NULL), '') AS kept FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.n = g.n GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_dropped, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM kept""",
    "op7_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, n, base, substr(h, 2 * base + 1, 2198) AS h FROM (SELECT doc_id, n, h, unnest(range(0, n - 99, 1000)) AS base FROM d WHERE n >= 100)),
w AS (
  SELECT doc_id, base + i AS p, doc_id * 4294967296 + base + i AS place, md5(substr(h, 2 * i + 1, 200)) AS k
  FROM (SELECT doc_id, base, h, unnest(range(least(1000, n - 99 - base))) AS i FROM c)
),
f AS (SELECT k, min(place) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, p, p > 100 + coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS new FROM w JOIN f USING (k) WHERE place > first),
g AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM r) GROUP BY doc_id, run),
s AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM g GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM (SELECT doc_id, a, b FROM g UNION ALL SELECT doc_id, n, n FROM d)),
kept AS (SELECT doc_id, coalesce(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x), '') AS h FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) JOIN kept USING (doc_id)""",
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.w::DOUBLE[], c.w::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.w) = len(c.w) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
