"""Source-adapter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import adapt as A
from .registry import query


@query("""SELECT p_partkey, CAST(o AS INTEGER) AS order_index, n AS name, trim(m || ' ' || n) AS text FROM (SELECT p_partkey, unnest([0, 1, 2]) AS o, unnest([p_name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, p_type]) AS n, unnest([CAST(p_size AS VARCHAR), 'x', '']) AS m FROM part) WHERE n <> ''""")
def unpivot_pairs(t):
    names = [F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")), F.col("p_type")]
    items = A.numbered_pairs(names, [F.col("p_size").cast("string"), F.lit("x"), F.lit("")])
    return t("part").select("p_partkey", F.inline(items))


@query("SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'error') AS error, arg_min(value, event_id) FILTER (event_type = 'click') AS click, arg_min(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def pivot_key_values(t):
    return A.pivoted(t("events"), "user_id", "event_type", "value", ["error", "click", "view"], "event_id")


@query("SELECT * FROM (VALUES (1, '2 cups flour', 'flour', 'cup'), (1, 'salt', 'salt', NULL), (2, '1 egg', 'egg', NULL)) v(id, text, name, unit)")
def positional_zip(t):
    rows = [(1, ["2 cups flour", "salt"], [("flour", "cup"), ("", "<unit>")]), (2, ["1 egg"], [])]
    z = t.rows(rows, "id int, texts array<string>, details array<struct<name: string, unit: string>>")
    return z.select("id", F.inline(A.zipped(F.col("texts"), F.col("details"))))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN CAST(floor(l_extendedprice / l_quantity + 0.5) AS BIGINT) END AS each FROM lineitem")
def per_unit_ratio(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", A.per_unit(F.col("l_extendedprice"), F.col("l_quantity")).alias("each"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS order_index, x AS name FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, [y for y in [trim(x) for x in string_split(split_part(text, chr(10), 1), ',')] if y <> ''] AS l FROM documents))")
def comma_items(t):
    return t("documents").select("doc_id", F.inline(A.listed(F.split_part("text", F.lit("\n"), F.lit(1)))))


@query("SELECT doc_id, contains(text, 'License') OR lang = 'en' AS found FROM documents")
def schema_presence(t):
    licensed = F.filter(F.array("text"), lambda x: F.contains(x, F.lit("License")))
    return t("documents").select("doc_id", A.presence(F.array("source"), licensed, F.array(F.when(F.col("lang") == "en", "Recipe").otherwise("x")), ("http://schema.org/Recipe",)).alias("found"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'object' AS shape FROM events")
def field_aliases(t):
    return t("events").select("event_id", A.aliased(F.col("props"), "$.key", "$.k").cast("long").alias("k"), A.shape(F.col("props")).alias("shape"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') AND lower(p_type) = (SELECT lower(min(p_type)) FROM part) ORDER BY p_partkey LIMIT 5")
def filtered_search(t):
    p = t("part")
    kind = p.agg(F.min("p_type")).first()[0]  # one value: a parameter of the search
    return A.matching(p, F.col("p_name"), "Ring", F.col("p_type"), kind or "", 5, "p_partkey").select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10)")
def two_step_fetch(t):
    ids = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return A.details(ids, t("lineitem"), "l_orderkey", 10).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, CAST(i AS INTEGER) AS step_number, x AS text FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, [y for y in [trim(x) for x in string_split(text, chr(10))] if y <> ''] AS l FROM documents))")
def text_steps(t):
    return t("documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("step_number"), "text")


@query()
def text_fields(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.get(T.lines(c), 0).alias("title"), T.servings(c).alias("servings"), N.text_minutes(c).alias("minutes"), F.size(F.filter(T.lines(c), lambda x: T.item_line(x))).alias("n_items"))


@query("SELECT page_id FROM pages WHERE regexp_extract(url, '^https?://([^/:?#]+)', 1) NOT IN (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) FROM pages WHERE page_id % 9 = 0)")
def unblocked_pages(t):
    from ..functions.urls import host
    from ..sources.tables import unblocked

    p = t("pages")
    none = F.lit(None).cast("timestamp")
    every = p.where("page_id % 9 = 0").select(host(F.col("url")).alias("domain"), F.lit(False).alias("isTemporary"), none.alias("cooldownUntil"))
    expired = p.where("page_id % 9 = 1").select(host(F.col("url")).alias("domain"), F.lit(True).alias("isTemporary"), F.lit("2000-01-01").cast("timestamp").alias("cooldownUntil"))
    return unblocked(p, "url", every.union(expired), F.lit("2020-01-01").cast("timestamp")).select("page_id")


@query(r"""SELECT id, sitemap FROM (VALUES (1, 'User-agent: *' || chr(10) || 'Sitemap: https://a.com/s.xml' || chr(10) || 'sitemap:https://b.com/t.xml'), (2, 'none'), (3, NULL)) v(id, s)
  LEFT JOIN LATERAL (SELECT trim(regexp_replace(l, '(?i)^\s*sitemap:', '')) AS sitemap FROM (SELECT unnest(string_split(s, chr(10))) AS l) WHERE starts_with(lower(trim(l)), 'sitemap:')) ON true""")
def robots_lines(t):
    from ..sources.tables import robots_sitemaps

    rows = [(1, "User-agent: *\nSitemap: https://a.com/s.xml\nsitemap:https://b.com/t.xml"), (2, "none"), (3, None)]
    return t.rows(rows, "id int, text string").select("id", F.explode_outer(robots_sitemaps(F.col("text"))).alias("sitemap"))


API = "id int, title string, summary string, url string, items array<struct<original: string, original_name: string, name: string, amount: double, unit: string>>, analyzed array<struct<steps: array<struct<number: int, step: string>>>>, cuisines array<string>, dishes array<string>, diets array<string>, nutrients array<struct<name: string, amount: double>>"
ANSWERS = [
    (1, "Big Pie", "<b>Good</b> pie", "http://a.com/1", [("2 cups flour", None, "flour", 2.0, "cups"), ("salt", "sea salt", "salt", 0.0, "")], [([(1, "Mix"), (2, "Bake")],), ([(1, "Other")],)], ["French"], ["main"], [], [("Protein", 5.0), ("Calories", 300.0)]),
    (2, "Plain  Soup", None, "", [], [], [], ["soup"], ["vegan"], []),
]


@query("SELECT * FROM (VALUES (1, 'Big Pie', 'Good pie', 'http://a.com/1', 'flour|2.0|cups;sea salt||', '1 Mix;2 Bake', 'French', 'French,main', 300.0::DOUBLE, 5.0::DOUBLE), (2, 'Plain  Soup', NULL, 'plain-soup-2', '', '', NULL, 'soup,vegan', NULL, NULL)) v(id, title, description, source, items, steps, cuisine, tags, calories, protein)")
def api_records(t):
    rows = t.rows(ANSWERS, API)
    r = rows.select("id", A.api_record(F.struct(*rows.columns)).alias("r")).select("id", "r.*")
    items = F.transform("items", lambda x: F.concat_ws("|", x["name"], F.coalesce(x["quantity"].cast("string"), F.lit("")), F.coalesce(x["unit"], F.lit(""))))
    steps = F.transform("steps", lambda x: F.concat_ws(" ", x["step_number"], x["text"]))
    return r.select("id", "title", "description", "source", F.array_join(items, ";").alias("items"), F.array_join(steps, ";").alias("steps"), "cuisine", F.array_join("tags", ",").alias("tags"), "calories", "protein")


LINKED = [
    (1, '{"author": "Ann", "prepTime": "PT10M", "nutrition": {"fatContent": "12.5 g", "Sodium": "300 mg"}, "keywords": "quick, Dinner, vegan"}'),
    (2, '{"author": [{"name": "Bob"}, "C"], "preparationTime": "20 min", "nutrition": {"protein": "7"}}'),
    (3, '{"author": {"title": "Chef"}, "prepTime": {"text": "5 min"}, "nutrition": {"fat": "none"}, "keywords": "lunch"}'),
    (4, "no json"),
]


@query("SELECT * FROM (VALUES (1, 'Ann', 'PT10M', 12.5::DOUBLE, NULL::DOUBLE, 300.0::DOUBLE, 'Dinner', 'quick,vegan'), (2, 'Bob', '20 min', NULL, 7.0, NULL, '', ''), (3, 'Chef', '5 min', NULL, NULL, NULL, 'lunch', ''), (4, NULL, NULL, NULL, NULL, NULL, '', '')) v(id, author, prep, fat, protein, sodium, meals, tags)")
def linked_records(t):
    d = A.linked_data(F.col("json"))
    return t.rows(LINKED, "id int, json string").select("id", *(d[k].alias(k) for k in ("author", "prep", "fat", "protein", "sodium")), F.array_join(d["meals"], ",").alias("meals"), F.array_join(d["tags"], ",").alias("tags"))


SHAPES = [(1, '[{"a": 1}]'), (2, '{"a": 1}'), (3, "plain"), (4, "12"), (5, None), (6, "")]


@query("SELECT * FROM (VALUES (1, 'array'), (2, 'object'), (3, 'text'), (4, 'text'), (5, 'text'), (6, 'text')) v(id, shape)")
def payload_shapes(t):
    return t.rows(SHAPES, "id int, c string").select("id", A.shape(F.col("c")).alias("shape"))
