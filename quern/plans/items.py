"""Queries over item lines, time estimates, defaults and variations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import items as I
from ..functions.urls import host
from ..operators import dedup as D
from .matching import SHARED, TITLES, names, titled, tokens
from .registry import query
from .scoring import RECORD, fields, record


def values(rows, names_):
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({names_})"


QUANTITIES = [(1, "1 to 1 1/2 cups", 1.0, 1.5), (2, "2 to 3", 2.0, 3.0), (3, "2-3 cups", 2.0, 3.0), (4, "1 1/2 cup", 1.5, None), (5, "3/4 oz", 0.75, None), (6, "two eggs", 2.0, None), (7, "4.5 g", 4.5, None), (8, "salt", None, None)]


@query(values(QUANTITIES, "id, text, low, high"))
def quantity_patterns(t):
    rows = t.rows([r[:2] for r in QUANTITIES], "id int, text string")
    return rows.withColumn("q", I.quantity(F.col("text"))).select("id", "text", "q.low", "q.high")


ITEMS = [
    (1, "2 cups tomatoes, chopped", "tomato", "chopped", None, None),
    (2, "1 can (8 ounces) beans (about 227 g)", "can", "8 ounces", 227.0, 8.0),
    (3, "a pinch of salt, to taste", "salt", "to taste", None, None),
    (4, "2 large cloves garlic (10 ml)", "clove", "large", 10.0, None),
    (5, "", "unknown ingredient", None, None, None),
]


@query(values(ITEMS, "id, text, name, notes, grams, inner_quantity"))
def item_lines(t):
    c = F.col("text")
    rows = t.rows([r[:2] for r in ITEMS], "id int, text string")
    name = I.core_name(c, F.coalesce(I.quantity(c)["low"], F.lit(1.0)))
    return rows.select("id", "text", name.alias("name"), I.notes(c, name).alias("notes"), I.explicit_grams(c).alias("grams"), I.parenthetical_unit(c)["quantity"].alias("inner_quantity"))


WORD = "(SELECT doc_id, lower(split_part(text, ' ', 2)) AS w FROM documents)"


@query(f"""SELECT doc_id, w, CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN ends_with(w, 'ves') AND length(w) > 4 THEN left(w, length(w) - 3) || 'f' WHEN ends_with(w, 'ses') AND length(w) > 4 THEN left(w, length(w) - 2)
  WHEN ends_with(w, 's') AND length(w) > 3 AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END AS many FROM {WORD}""")
def lemmas(t):
    w = F.lower(F.split_part("text", F.lit(" "), F.lit(2)))
    return t("documents").select("doc_id", w.alias("w")).select("doc_id", "w", I.lemma(F.col("w"), F.lit(2)).alias("many"))


@query("SELECT DISTINCT p_name, CASE WHEN contains(p_name, 'ring') THEN 0.5 WHEN contains(p_name, 'bolt') THEN 7.8 ELSE 1.0 END::DOUBLE AS density FROM part")
def density_lookup(t):
    return names(t).select("p_name", I.density(F.col("p_name"), {"ring": 0.5, "bolt": 7.8}).alias("density"))


@query("""SELECT p_name, array_to_string(list_filter_empty, '|') AS variations FROM (SELECT p_name, [x for x in [p_name, CASE WHEN contains(p_name, 'ring') THEN regexp_replace(p_name, 'ring', 'band') END, CASE WHEN ends_with(p_name, 's') AND NOT ends_with(p_name, 'ss') THEN regexp_replace(p_name, 's$', '') END] if x IS NOT NULL] AS list_filter_empty FROM (SELECT DISTINCT p_name FROM part))""")
def search_variations(t):
    return names(t).select("p_name", F.array_join(I.variations(F.col("p_name"), {"ring": ("band",)}), "|").alias("variations"))


def sum_steps(rules):
    return " + ".join(f"CASE WHEN {' OR '.join(f'contains(lower(s), {chr(39)}{w}{chr(39)})' for w in words)} THEN {n} ELSE 0 END" for words, n in rules)


@query(f"SELECT doc_id, CAST(greatest(coalesce(list_sum([{sum_steps(I.PREP_MINUTES)} for s in steps]), 0), 10) AS INTEGER) AS prep FROM {RECORD}")
def prep_estimate(t):
    return record(t).select("doc_id", I.prep_minutes(F.col("steps")).alias("prep"))


@query(f"SELECT doc_id, CAST(greatest(coalesce(list_sum([CASE WHEN len(regexp_extract_all(lower(s), '[0-9]+\\s*(?:minute|min|hour|hr)s?')) > 0 THEN list_sum([CAST(regexp_extract(m, '[0-9]+') AS BIGINT) * CASE WHEN regexp_matches(m, 'hour|hr') THEN 60 ELSE 1 END for m in regexp_extract_all(lower(s), '[0-9]+\\s*(?:minute|min|hour|hr)s?')]) ELSE CASE "
       + " ".join(f"WHEN {' OR '.join(f'contains(lower(s), {chr(39)}{w}{chr(39)})' for w in words)} THEN {n}" for words, n in I.COOK_MINUTES)
       + f" ELSE 0 END END for s in steps]), 0), 5) AS BIGINT) AS cook FROM {RECORD}")
def cook_estimate(t):
    return record(t).select("doc_id", I.cook_minutes(F.col("steps")).alias("cook"))


@query()
def cook_estimate_carried(t):
    return record(t).select("doc_id", I.cook_minutes(F.col("steps"), carried=True).alias("cook"))


@query("SELECT doc_id, CAST(CASE WHEN regexp_extract(text, '[0-9]+') = '' THEN 4 ELSE greatest(least(coalesce(try_cast(regexp_extract(text, '[0-9]+') AS INTEGER), 4), 50), 1) END AS INTEGER) AS servings FROM documents")
def servings_default(t):
    return t("documents").select("doc_id", I.servings_of(F.col("text")).alias("servings"))


@query(f"SELECT doc_id, CAST(coalesce(nullif(CASE WHEN total <= 0 THEN 5 ELSE total END, -1), 0) AS BIGINT) AS total, CAST(CASE WHEN prep <= 0 THEN 5 ELSE prep END + CASE WHEN cook <= 0 THEN 5 ELSE cook END AS BIGINT) AS planned FROM {RECORD}")
def total_time_fallback(t):
    none = F.lit(None).cast("long")
    return record(t).select("doc_id", I.total_minutes(F.col("prep"), F.col("cook"), F.col("total")).cast("long").alias("total"), I.total_minutes(F.col("prep"), F.col("cook"), none).cast("long").alias("planned"))


@query(f"SELECT doc_id, CASE WHEN contains(lower(title), 'italian') THEN 'Italian' WHEN contains(lower(title), 'french') THEN 'French' ELSE 'International' END AS cuisines, array_to_string(tags, '|') AS tags FROM {RECORD}")
def default_lists(t):
    d = I.defaults(fields())
    return record(t).select("doc_id", F.array_join(d["cuisines"], "|").alias("cuisines"), F.array_join(d["tags"], "|").alias("tags"))


@query("SELECT page_id, split_part(regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www\\.', ''), '.', 1) || ' Chef' AS author FROM pages")
def author_fallback(t):
    return t("pages").select("page_id", I.site_author(host(F.col("url")), {}).alias("author"))


AUTHORS = [(1, "By Ann Lee | Site", "Ann Lee", True), (2, "Test Kitchen", "Test Kitchen", False), (3, "4 2", "4 2", False), (4, "Bo - Editor", "Bo", True), (5, "x", "x", False)]


@query(values([(a, b, c, d) for a, b, c, d in AUTHORS], "id, text, name, valid"))
def author_names(t):
    rows = t.rows([r[:2] for r in AUTHORS], "id int, text string")
    return rows.select("id", "text", I.clean_author(F.col("text")).alias("name"), I.valid_author(F.col("text")).alias("valid"))


@query(f"SELECT doc_id, CAST(greatest(0, 100 - 5 * CAST(lang <> 'en' AS INTEGER)) AS INTEGER) AS compliance, round(CASE WHEN len(steps) > 0 AND len(items) > 0 THEN len([x for x in items if contains(lower(text), lower(x))]) / len(items) ELSE 0 END, 6)::DOUBLE AS mentioned, round(0.2 + CASE WHEN len(items) > 0 THEN 0.3 ELSE 0 END + CASE WHEN len(steps) > 0 THEN 0.3 ELSE 0 END + CASE WHEN title <> '' THEN 0.2 ELSE 0 END, 6)::DOUBLE AS media FROM (SELECT *, tags[1] AS lang FROM {RECORD})")
def integrity_parts(t):
    names_ = F.array(F.lit("title"), F.get("tags", 0))
    return record(t).select("doc_id", I.compliance(names_, ("title", "en")).alias("compliance"), F.round(I.mentioned(F.col("items"), F.col("text")), 6).alias("mentioned"), F.round(I.media_completeness(F.col("text"), F.col("items"), F.col("steps"), F.col("title")), 6).alias("media"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * 0.25 + l_linenumber * 10 * 0.25 + l_discount * 100 * 0.15 + l_tax * 100 * 0.15 + 100 * 0.20 + 0.5) AS BIGINT) AS score FROM lineitem")
def integrity_score(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", I.integrity(F.col("l_quantity"), F.col("l_linenumber") * 10, F.col("l_discount") * 100, F.col("l_tax") * 100, F.lit(100)).alias("score"))


@query(f"""WITH {SHARED}, {TITLES}, d AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY k) AS first FROM k),
  j AS (SELECT DISTINCT b AS doc_id FROM shared WHERE hits >= 0.75 * (n + m - hits)), c AS (SELECT DISTINCT b AS doc_id FROM composite WHERE score >= 0.85)
  SELECT d.doc_id, CASE WHEN first < d.doc_id THEN 'title' WHEN j.doc_id IS NOT NULL THEN 'ingredients' WHEN c.doc_id IS NOT NULL THEN 'composite' END AS match FROM d LEFT JOIN j ON d.doc_id = j.doc_id LEFT JOIN c ON d.doc_id = c.doc_id""")
def duplicate_cascade(t):
    """Title, items, composite; documents have no URL, so that stage finds none."""
    docs = titled(t).select("doc_id", "k")
    first = docs.groupBy("k").agg(F.min("doc_id").alias("first"))
    yes, no = F.lit(True), F.lit(False)
    links = D.token_pairs(tokens(t), "doc_id", "t", D.composite_need())
    near = links.where("similarity >= 0.75").select(F.col("b").alias("doc_id")).distinct().withColumn("near", yes)
    # Of rows that the items decide none needs a score: those are the ends of such links, copies of a set included.
    far = links.join(near.select(F.col("doc_id").alias("b")), "b", "left_anti")
    both = D.composite_pairs(titled(t), "doc_id", "k", "t", links=far).select(F.col("b").alias("doc_id")).distinct().withColumn("both", yes)
    rows = docs.join(first.withColumnRenamed("k", "key"), F.col("k").eqNullSafe(F.col("key"))).join(near, "doc_id", "left").join(both, "doc_id", "left")
    return rows.select("doc_id", D.match_type(F.col("first") < F.col("doc_id"), no, F.coalesce("near", no), F.coalesce("both", no)).alias("match"))
