"""Lookup, join, similarity and dedup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import dedup as D
from ..operators import graph as G
from ..operators import lookup as L
from ..operators import vectors as V
from .registry import query
from .texts import TITLE_KEY

ENTRIES = [("ring", 0), ("small ring", 1), ("large bolt", 2), ("bolt", 3), ("steel plate", 4), ("gear", 5), ("tiny gear", 6), ("nut", 7), ("red valve", 8)]
ALIASES = [("blue ring", "ring", 0), ("blue bolt", "bolt", 1), ("blue bolt", "gear", 2), ("hot gear", "gear", 3)]
VALUES = "(VALUES " + ", ".join(f"('{a}', {b})" for a, b in ENTRIES) + ") e(name, ord)"
ALIAS_VALUES = "(VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in ALIASES) + ") a(alias, name, ord)"
NAMES = "(SELECT DISTINCT p_name FROM part)"
LEV = "(1 - levenshtein(lower(p_name), lower(name)) / greatest(length(p_name), length(name)))"


def entries(t):
    return t.rows(ENTRIES, "name string, ord int")


def names(t):
    return t("part").select("p_name").distinct()


@query(f"SELECT p_partkey, e.name AS match FROM part LEFT JOIN {VALUES} ON lower(trim(p_name)) = name")
def lookup_exact(t):
    return L.exact(t("part"), F.col("p_name"), entries(t), "name").select("p_partkey", "match")


@query(f"SELECT p_partkey, a.name AS match FROM part LEFT JOIN (SELECT alias, arg_min(name, ord) AS name FROM {ALIAS_VALUES} GROUP BY alias) a ON lower(trim(p_name)) = alias")
def lookup_alias(t):
    return L.by_alias(t("part"), F.col("p_name"), t.rows(ALIASES, "alias string, name string, ord int")).select("p_partkey", "match")


@query(f"SELECT p_partkey, (SELECT arg_min(name, ord) FROM {VALUES} WHERE contains(p_name, name) OR contains(name, p_name)) AS match FROM part")
def lookup_first_match(t):
    return L.first_match(t("part"), "p_name", entries(t), "name", L.contains_either("p_name", "name")).select("p_partkey", "match")


@query(f"SELECT p_name, arg_max(name, (s, -ord)) AS match, round(max(s), 6) AS score FROM (SELECT p_name, name, ord, {LEV} AS s FROM {NAMES}, {VALUES}) WHERE s >= 0.6 GROUP BY p_name")
def lookup_fuzzy(t):
    return L.best_match(names(t), "p_name", entries(t), "name", S.similarity, 0.6).select("p_name", "match", F.round("score", 6).alias("score"))


PHONETIC = """CASE WHEN {w} = '' THEN '' ELSE rpad(upper({w})[1] || left(CASE WHEN regexp_matches(upper({w})[1], '[BFPVCGJKQSXZDTLMNR]') THEN {r}[2:] ELSE {r} END, 3), 4, '0') END"""
RUNS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(upper({w}), '[^BFPVCGJKQSXZDTLMNR]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g')"


def sql_phonetic(w):
    return PHONETIC.format(w=w, r="(" + RUNS.format(w=w) + ")")


@query(f"SELECT DISTINCT w, {sql_phonetic('w')} AS code FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT n_name FROM nation UNION SELECT unnest(['Tymczak', 'Pfister', '']) )")
def phonetic_key(t):
    words = t("part").select(F.explode(F.split("p_name", " ")).alias("w")).union(t("nation").select("n_name")).union(t.rows([("Tymczak",), ("Pfister",), ("",)], "w string"))
    return words.distinct().select("w", S.phonetic(F.col("w")).alias("code"))


SOUNDS = f"(SELECT count(*) FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w) x WHERE EXISTS (SELECT 1 FROM (SELECT unnest(string_split(lower(name), ' ')) AS v) y WHERE {sql_phonetic('w')} = {sql_phonetic('v')}))"


@query(f"SELECT p_name, arg_max(name, (s, -ord)) AS match, round(max(s), 6) AS score FROM (SELECT p_name, name, ord, least({LEV} + {SOUNDS} / greatest(len(string_split(p_name, ' ')), len(string_split(name, ' '))) * 0.2, 1.0) AS s FROM {NAMES}, {VALUES}) WHERE s >= 0.6 GROUP BY p_name")
def lookup_phonetic(t):
    return L.best_match(names(t), "p_name", entries(t), "name", S.boosted, 0.6, boost=0.2).select("p_name", "match", F.round("score", 6).alias("score"))


@query(f"SELECT p_name, name FROM {NAMES}, {VALUES} WHERE {LEV} >= 0.7 OR ({LEV} >= 0.5 AND {SOUNDS} > 0)")
def close_match_pairs(t):
    return L.like_lengths(names(t), "p_name", entries(t), "name", 0.5).where(S.close(F.col("p_name"), F.col("name"))).select("p_name", "name")


@query(f"""WITH n AS {NAMES}, x AS (SELECT p_name, e.name AS m1 FROM n LEFT JOIN {VALUES} ON p_name = name), y AS (SELECT x.*, a.name AS m2 FROM x LEFT JOIN (SELECT alias, arg_min(name, ord) AS name FROM {ALIAS_VALUES} GROUP BY alias) a ON p_name = alias),
  z AS (SELECT p_name, arg_max(name, (s, -ord)) AS m3, max(s) AS s FROM (SELECT p_name, name, ord, {LEV} AS s FROM y, {VALUES} WHERE m1 IS NULL AND m2 IS NULL) WHERE s >= 0.6 GROUP BY 1)
  SELECT p_name, coalesce(m1, m2, m3, p_name) AS match, CASE WHEN m1 IS NOT NULL THEN 'exact' WHEN m2 IS NOT NULL THEN 'alias' WHEN m3 IS NOT NULL THEN 'fuzzy' ELSE 'created' END AS how,
  round(CASE WHEN m1 IS NOT NULL THEN 1.0 WHEN m2 IS NOT NULL THEN 0.9 WHEN m3 IS NOT NULL THEN s ELSE 0.3 END, 6)::DOUBLE AS confidence FROM y LEFT JOIN z USING (p_name)""")
def lookup_cascade(t):
    return L.cascade(names(t), "p_name", entries(t), t.rows(ALIASES, "alias string, name string, ord int"), "name")


@query("SELECT count(*) AS n, round(avg(confidence), 6) AS mean, avg(confidence) < 0.7 AS low FROM (SELECT CASE WHEN p_size > 25 THEN 1.0 ELSE 0.3 END::DOUBLE AS confidence FROM part)")
def link_statistics(t):
    rows = t("part").select(F.when(F.col("p_size") > 25, 1.0).otherwise(0.3).alias("confidence"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), (F.avg("confidence") < 0.7).alias("low"))


@query("SELECT name, id FROM (VALUES ('click', 1::BIGINT), ('zoom', 5::BIGINT)) k(name, id) UNION ALL SELECT event_type, 5 + row_number() OVER (ORDER BY event_type) FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'click')")
def lookup_get_or_create(t):
    return L.get_or_create(t("events"), "event_type", t.rows([("click", 1), ("zoom", 5)], "name string, id long"))


@query("SELECT p_type, arg_min(p_partkey, (CASE WHEN p_size > 40 AND contains(p_name, 'ring') THEN 0 ELSE 1 END, p_partkey)) AS chosen FROM part GROUP BY p_type")
def preferred_candidate(t):
    return L.preferred(t("part"), "p_type", (F.col("p_size") > 40) & F.contains("p_name", F.lit("ring")), "p_partkey").select("p_type", F.col("p_partkey").alias("chosen"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_retailprice END, CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE END, 1.0) AS value FROM part")
def source_fallback(t):
    p = t("part")
    a = p.where("p_size % 2 = 0").select("p_partkey", F.col("p_retailprice").alias("value"))
    b = p.where("p_size % 3 = 0").select("p_partkey", F.col("p_size").cast("double").alias("value"))
    return L.first_source(p.select("p_partkey"), "p_partkey", a, b, p.select("p_partkey", F.lit(1.0).alias("value")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT conv_id, count(*) AS n FROM conversations c WHERE EXISTS (SELECT 1 FROM (VALUES ('the'), ('der'), ('les')) w(w) WHERE contains(lower(c.text), w)) GROUP BY 1")
def semi_join(t):
    words = F.array(*map(F.lit, ("the", "der", "les")))
    return t("conversations").where(F.exists(words, lambda w: F.contains(F.lower("text"), w))).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, n_name, CAST(max(o_totalprice) AS DOUBLE) AS best FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON c_custkey = o_custkey WHERE contains(c_name, '1') GROUP BY ALL")
def optional_outer_union(t):
    c = t("customer").where(F.contains("c_name", F.lit("1")))
    c = c.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.groupBy("c_custkey", "n_name").agg(F.max("o_totalprice").alias("best"))


@query("SELECT l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = 7 ORDER BY l_shipdate DESC, l_linenumber")
def parent_children(t):
    rows = t("lineitem").where("l_orderkey = 7").orderBy(F.desc("l_shipdate"), "l_linenumber")
    return rows.select("l_linenumber", F.struct("l_partkey", "l_suppkey").alias("keys")).select("l_linenumber", "keys.*")


@query("SELECT o_orderkey, min(o_orderdate)::DATE::VARCHAR AS date, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def flat_to_nested(t):
    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    parts = F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",")
    return rows.groupBy("o_orderkey").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("date"), parts.alias("parts"))


@query(f"SELECT min(p_partkey) AS p_partkey FROM part GROUP BY {TITLE_KEY.format('p_name')}")
def title_key_dedup(t):
    return D.first_of_key(t("part"), T.title_key(F.col("p_name")), "p_partkey").select("p_partkey")


TOKENS = "SELECT doc_id, list_distinct([x for x in regexp_split_to_array(lower(coalesce(text, '')), '[ \n]+') if x <> '']) AS t FROM documents"
# Pairs by tokens that both have; n and m are the sets' sizes.
SHARED = f"""w AS ({TOKENS}), x AS (SELECT doc_id, len(t) AS n, unnest(t) AS token FROM w),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS hits FROM x a JOIN x b ON a.token = b.token AND a.doc_id < b.doc_id AND a.n <= b.n / 0.62 AND b.n <= a.n / 0.62 GROUP BY 1, 2)"""


def words():
    """The distinct words of all lines."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[ \n]+"), lambda x: x != ""))


def tokens(t):
    return t("documents").select("doc_id", words().alias("t"))


@query(f"WITH {SHARED} SELECT DISTINCT b AS doc_id FROM shared WHERE hits >= 0.75 * (n + m - hits)")
def token_jaccard_pairs(t):
    pairs = D.token_pairs(tokens(t), "doc_id", "t", 0.75)
    return pairs.select(F.col("b").alias("doc_id")).distinct()


TITLES = f"""k AS (SELECT doc_id, {TITLE_KEY.format("split_part(text, chr(10), 1)")} AS k FROM documents), composite AS (SELECT a, b, 0.6 * (CASE WHEN greatest(length(ka.k), length(kb.k)) = 0 THEN 0 ELSE 1 - levenshtein(ka.k, kb.k) / greatest(length(ka.k), length(kb.k)) END) + 0.4 * hits / (n + m - hits) AS score
  FROM shared JOIN k ka ON ka.doc_id = a JOIN k kb ON kb.doc_id = b WHERE hits >= 0.625 * (n + m - hits))"""


def titled(t):
    """doc_id, k (key of the first line), t (the words of all lines)."""
    return t("documents").select("doc_id", T.title_key(F.split_part("text", F.lit("\n"), F.lit(1))).alias("k"), words().alias("t"))


@query(f"WITH {SHARED}, {TITLES} SELECT DISTINCT b AS doc_id FROM composite WHERE score >= 0.85")
def composite_pairs(t):
    return D.composite_pairs(titled(t), "doc_id", "k", "t").select(F.col("b").alias("doc_id")).distinct()


@query()
def greedy_dedup(t):
    docs = t("documents").select("doc_id")
    return D.greedy(docs, D.token_pairs(tokens(t), "doc_id", "t", 0.75), "doc_id")


@query(f"SELECT count(*) AS n, count(DISTINCT {TITLE_KEY.format('p_name')}) AS titles FROM part")
def dedup_statistics(t):
    return t("part").agg(F.count("*").alias("n"), F.count_distinct(T.title_key(F.col("p_name"))).alias("titles"))


EDGES = "SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"


@query(f"WITH RECURSIVE e AS ({EDGES}), w(node, depth) AS (SELECT 'r1', 0 UNION SELECT b, depth + 1 FROM w JOIN e ON node = a) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def recursive_reach(t):
    n = t("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"))
    s = t("supplier").select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey"))
    return G.reach(n.union(s).distinct(), t.rows([("r1",)], "node string"), 10)


COS = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


@query(f"SELECT query, vec_id, similarity FROM (SELECT q.vec_id AS query, c.vec_id, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 6) DESC, c.vec_id) AS n FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id) WHERE n <= 10")
def cosine_topk(t):
    e = t("embeddings")
    return V.nearest(e.where("vec_id % 50 = 0"), e, 10)


@query(f"SELECT query, label, similarity FROM (SELECT q.vec_id AS query, c.label, round(max({COS}), 6) AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)")
def nearest_by_label(t):
    e = t("embeddings")
    return V.nearest_by_group(e.where("vec_id % 50 = 0"), e, "label")
