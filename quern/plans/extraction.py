"""Page extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import extract as X
from .registry import query

LD = '<script type="application/ld+json">{}</script>'
PAGES = [
    (1, LD.format('{"@type": "Recipe", "name": "A", "recipeYield": "4 to 6", "prepTime": "PT1H5M", "recipeIngredient": ["x", "y"], "recipeInstructions": [{"text": "s1"}, {"text": "s2"}], "author": {"name": "Ann"}, "image": ["i.png"]}')),
    (2, LD.format('{"@graph": [{"@type": "Person"}, {"@type": ["Thing", "Recipe"], "name": "B", "recipeInstructions": "one step", "author": "Bob", "image": {"url": "u"}}]}')),
    (3, LD.format('[{"@type": "WebPage"}, {"@type": "Recipe", "headline": "C"}]')),
    (4, LD.format("{broken") + LD.format('{"@type": "Recipe", "name": "D"}')),
    (5, "<p>none</p>"),
    (6, None),
]


@query("SELECT * FROM (VALUES (1, 'A', 6, 65::BIGINT, 2, 's1|s2', 'Ann', 'i.png'), (2, 'B', 4, NULL, 0, 'one step', 'Bob', 'u'), (3, 'C', 4, NULL, 0, '', NULL, NULL), (4, 'D', 4, NULL, 0, '', NULL, NULL)) v(id, title, servings, prep, n_items, steps, author, image_url)")
def structured_blocks(t):
    rows = t.rows(PAGES, "id int, html string").select("id", X.first_object(F.col("html")).alias("v")).where("v IS NOT NULL")
    r = rows.select("id", X.record(F.col("v")).alias("r"))
    return r.select("id", "r.title", "r.servings", "r.prep", F.size("r.items").alias("n_items"), F.array_join("r.steps", "|").alias("steps"), "r.author", "r.image_url")


@query()
def html_blocks(t):
    return X.parsed(t("pages"))


@query()
def page_author(t):
    return t("pages").select("page_id", X.author(F.col("html"), F.col("url"), {}).alias("author"))


@query("SELECT page_id, CAST(len([x for x in regexp_extract_all(html, '<a[^>]+href=\"([^\"]+)\"', 1) if starts_with(x, '/') OR regexp_extract(x, '^https?://([^/:?#]+)', 1) = regexp_extract(url, '^https?://([^/:?#]+)', 1)]) AS BIGINT) AS n FROM pages")
def link_extract_same_host(t):
    rows = t("pages").select("page_id", "url", U.links(F.col("html")).alias("links"))
    own = F.filter("links", lambda x: F.startswith(x, F.lit("/")) | (U.host(x) == U.host(F.col("url"))))
    return rows.select("page_id", F.size(own).cast("long").alias("n"))


@query("SELECT min(page_id) AS page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]+href=\"([^\"]+)\"', 1)) AS link FROM pages) GROUP BY link")
def discovered_links(t):
    return t("pages").select("page_id", F.explode(U.links(F.col("html"))).alias("link")).groupBy("link").agg(F.min("page_id").alias("page_id"))
