"""Queries over fields read from text and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import text as T
from .registry import query

NUTRIENTS = [(1, "250 kcal", "24 g", "66 mg", "1188 mg"), (2, "0", "1.5g", "0 mg", "12"), (3, None, "-3 g", None, "15000 mg"), (4, "abc", "g", "2500 mg", "x"), (5, "99.5", " 7G ", "1000", "10000 mg")]
GRAMS = "try_cast(nullif(regexp_extract(regexp_replace(lower({0}), '[g\\s]', '', 'g'), '^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)'), '') AS DOUBLE)"
NUMBER = "try_cast(nullif(regexp_extract({0}, '[0-9]+\\.?[0-9]*'), '') AS DOUBLE)"


def text(x):
    return "NULL" if x is None else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("﻿", "' || chr(65279) || '") + "'"


def rows_of(values, names):
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, float)) else text(x) for x in r) + ")" for r in values) + f") v({names})"


@query(f"""SELECT id, CASE WHEN calories >= 0 THEN calories END AS calories, CASE WHEN protein >= 0 THEN protein END AS protein, round(CASE WHEN cholesterol > 1 THEN cholesterol / 1000 ELSE cholesterol END, 9) AS cholesterol, round(CASE WHEN sodium > 10 THEN sodium / 1000 ELSE sodium END, 9) AS sodium
  FROM (SELECT id, {NUMBER.format('a')} AS calories, {GRAMS.format('b')} AS protein, nullif({NUMBER.format('c')}, 0) / 1000 AS cholesterol, nullif({NUMBER.format('d')}, 0) / 1000 AS sodium FROM {rows_of(NUTRIENTS, 'id, a, b, c, d')})""")
def nutrient_values(t):
    rows = t.rows(NUTRIENTS, "id int, calories string, protein string, cholesterol string, sodium string")
    n = X.plausible(X.nutrients({k: F.col(k) for k in ("calories", "protein", "cholesterol", "sodium")}))
    return rows.select("id", n["calories"].alias("calories"), n["protein"].alias("protein"), F.round(n["cholesterol"], 9).alias("cholesterol"), F.round(n["sodium"], 9).alias("sodium"))


@query(r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct([x for x in [y::BIGINT for y in regexp_extract_all(text, '(?i)([0-9]{1,9})(?:\s*(?:to|-)\s*[0-9]+)?\s*(?:minutes?|mins?)', 1) || regexp_extract_all(text, '(?i)[0-9]+\s*(?:to|-)\s*([0-9]{1,9})\s*(?:minutes?|mins?)', 1)] if x <> 0])), ',') AS minutes
  FROM (SELECT conv_id, turn, 'Bake for ' || turn || ' to ' || (turn + 5) || ' minutes, stir ' || conv_id || '-12 mins; ' || text AS text FROM conversations)""")
def step_timers(t):
    said = F.concat(F.lit("Bake for "), "turn", F.lit(" to "), F.col("turn") + 5, F.lit(" minutes, stir "), "conv_id", F.lit("-12 mins; "), "text")
    return t("conversations").select("conv_id", "turn", F.array_join(X.step_minutes(said), ",").alias("minutes"))


TIMES = [(1, "Prep time: 15 min, cook: 1 hr 20 min"), (2, "prep: 1:30 Total time 45 minutes"), (3, "COOK TIME 2h, prep 10 mins"), (4, "no times"), (5, "total: 2 hours 5 minutes cook time 0:45"), (6, None)]


def kind_sql(kind):
    out = []
    for form in ("min", "colon", "hour"):
        for name in (rf"{kind}\s*time\s*:?\s*", rf"{kind}\s*:?\s*"):
            p = "(?i)" + name + {"min": r"([0-9]{1,3})\s*(?:min|mins?|minutes?)", "colon": "([0-9]{1,2}):([0-9]{1,2})", "hour": r"([0-9]{1,3})\s*(?:h|hr|hrs|hour|hours)\s*([0-9]{1,3})?\s*(?:min|mins?|minutes?)?"}[form]
            a = f"regexp_extract(s, '{p}', 1)::BIGINT"
            out.append(f"WHEN regexp_matches(s, '{p}') THEN " + (a if form == "min" else f"{a} * 60 + coalesce(try_cast(nullif(regexp_extract(s, '{p}', 2), '') AS BIGINT), 0)"))
    return "CASE " + " ".join(out) + " END"


@query(f"SELECT id, {kind_sql('prep')} AS prep, {kind_sql('cook')} AS cook, {kind_sql('total')} AS total FROM {rows_of(TIMES, 'id, s')}")
def times_by_kind(t):
    return t.rows(TIMES, "id int, s string").select("id", *(X.kind_minutes(F.col("s"), k).alias(k) for k in ("prep", "cook", "total")))


@query("SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' Bytes' WHEN b < 1048576 THEN replace(printf('%.2f', floor(b / 1024 * 100 + 0.5) / 100), '.00', '') || ' KB' ELSE 'large' END AS size FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey AS BIGINT) AS b FROM orders) WHERE b < 1024 OR floor(b / 1024 * 100 + 0.5) % 10 <> 0 OR floor(b / 1024 * 100 + 0.5) % 100 = 0")
def byte_sizes(t):
    b = (F.col("o_orderkey") * F.col("o_orderkey")).cast("long")
    cents = F.floor(b / 1024 * 100 + 0.5)
    rows = t("orders").where((b < 1024) | (cents % 10 != 0) | (cents % 100 == 0))
    return rows.select("o_orderkey", F.when(b < 1048576, X.human_bytes(b)).otherwise("large").alias("size"))


MAPS = [(1, "﻿ <?xml?><sitemapindex><sitemap><loc>https://a.com/s1.xml</loc></sitemap><sitemap><loc> http://a.com/s2.xml </loc><lastmod>2024-01-02</lastmod></sitemap></sitemapindex>"), (2, "junk<urlset><url><loc>https://a.com/x</loc><lastmod>2024-05-06</lastmod></url><url><loc>ftp://no</loc></url></urlset>"), (3, "broken <loc>https://b.org/1</loc><LOC>https://b.org/2</LOC>"), (4, ""), (5, None)]


@query(f"""SELECT id, kind, loc, lastmod FROM (SELECT id, kind, trim(regexp_extract(x, '(?is)<loc>([^<]+)</loc>', 1)) AS loc, nullif(trim(regexp_extract(x, '(?is)<lastmod>([^<]+)</lastmod>', 1)), '') AS lastmod
  FROM (SELECT id, kind, unnest(regexp_extract_all(xml, CASE kind WHEN 'index' THEN '(?is)<sitemap>.*?</sitemap>' WHEN 'urlset' THEN '(?is)<url>.*?</url>' ELSE '(?is)<loc>[^<]+</loc>' END)) AS x FROM (SELECT *, CASE WHEN xml LIKE '%<sitemapindex%' THEN 'index' WHEN xml LIKE '%<urlset%' THEN 'urlset' ELSE 'loc' END AS kind FROM {rows_of(MAPS, 'id, xml')}))) WHERE starts_with(loc, 'http')""")
def sitemap_tree(t):
    return t.rows(MAPS, "id int, xml string").select("id", F.explode(X.sitemap_entries(F.col("xml"))).alias("e")).select("id", "e.*")


ROBOTS = "User-agent: *\nDisallow: /private/\nAllow: /private/open\nDisallow: /*.pdf$\n\nUser-agent: newsbot\nUser-agent: cookbot # ours\nDisallow: /\nAllow: /recipes/\nCrawl-delay: 3"
PATHS = [(1, "/private/x", "otherbot", False), (2, "/private/open/y", "otherbot", True), (3, "/a.pdf", "otherbot", False), (4, "/a.pdfx", "otherbot", True), (5, "/recipes/1", "CookBot", True), (6, "/about", "cookbot", False), (7, "/private/x", "cookbot", False), (8, "/", "otherbot", True)]


@query(f"SELECT id, allowed FROM (VALUES {', '.join(f'({i}, {str(x).lower()})' for i, _, _, x in PATHS)}, (9, true)) v(id, allowed)")
def robots_checks(t):
    rows = t.rows([(i, p, a, ROBOTS) for i, p, a, _ in PATHS] + [(9, "/x", "otherbot", None)], "id int, path string, agent string, robots string")
    checked = F.when(F.lower("agent") == "cookbot", X.robots_allowed(F.col("robots"), F.col("path"), "CookBot")).otherwise(X.robots_allowed(F.col("robots"), F.col("path"), "otherbot"))
    return rows.select("id", checked.alias("allowed"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)
  SELECT page_id, 'https://' || host || '/feed/' AS feed, 'https://www.' || host || '/post-sitemap.xml' AS sitemap, 14::INTEGER AS n FROM h""")
def discovery_guesses(t):
    from ..functions.urls import host

    both = F.concat(X.guesses(host(F.col("url")), X.FEEDS), X.guesses(host(F.col("url")), X.SITEMAPS))
    return t("pages").select("page_id", F.get(both, 0).alias("feed"), F.get(both, 13).alias("sitemap"), F.size(both).alias("n"))


FEED = "<rss><link>https://a.com/recipe/pie</link><link> https://a.com/about </link><link>https://a.com/recipes/</link><LINK>https://a.com/2024/05/soup</LINK></rss>"
HOME = "<a href='/recipe/pie'>p</a> <a href=\"recipes/soup\">s</a><a href='//cdn.a.com/best-cake-recipe'>c</a><a href='/2024/05/stew'>t</a><a href='/recipe/pie'>again</a><a href='/about'>a</a>"


@query("SELECT * FROM (VALUES ('feed', 0::BIGINT, 'https://a.com/recipe/pie'), ('feed', 1, 'https://a.com/2024/05/soup'), ('home', 0, 'https://a.com/recipe/pie'), ('home', 1, 'https://cdn.a.com/best-cake-recipe'), ('home', 2, 'https://a.com/2024/05/stew')) v(source, ord, url)")
def feed_and_home_links(t):
    rows = t.rows([(FEED, HOME, "https://a.com/")], "feed string, home string, base string")
    one = rows.select(F.lit("feed").alias("source"), F.posexplode(X.feed_links(F.col("feed"))).alias("ord", "url"))
    two = rows.select(F.lit("home").alias("source"), F.posexplode(X.home_links(F.col("home"), F.col("base"))).alias("ord", "url"))
    return one.unionByName(two).select("source", F.col("ord").cast("long").alias("ord"), "url")


@query(f"""SELECT doc_id, score / 10 AS score, score >= 7 AS valid, array_to_string([x for x in [CASE WHEN NOT a THEN 'text' END, CASE WHEN NOT b THEN 'items' END, CASE WHEN NOT c THEN 'steps' END, CASE WHEN NOT d THEN 'confidence' END] if x IS NOT NULL], ',') AS issues, CAST(equipment AS INTEGER) AS equipment
  FROM (SELECT *, 2 * a::INT + 3 * b::INT + 3 * c::INT + 2 * d::INT AS score FROM (SELECT doc_id, coalesce(length(text) > 10, false) AS a, coalesce(len([x for x in string_split(text, chr(10)) if trim(x) <> '']) >= 3, false) AS b, coalesce(len([x for x in regexp_split_to_array(text, '[.!?]+') if trim(x) <> '']) >= 3, false) AS c, doc_id % 10 >= 7 AS d,
  {' + '.join(f"coalesce(contains(lower(text), '{w}')::INT, 0)" for w in X.EQUIPMENT)} AS equipment FROM documents))""")
def reading_completeness(t):
    c = F.col("text")
    steps = F.filter(F.split(c, "[.!?]+"), lambda x: F.trim(x) != "")
    rows = t("documents").select("doc_id", X.completeness(c, T.lines(c), steps, F.col("doc_id") % 10 / 10).alias("r"), F.coalesce(F.size(X.equipment(c)), F.lit(0)).alias("equipment"))
    return rows.select("doc_id", "r.score", "r.valid", F.array_join("r.issues", ",").alias("issues"), "equipment")
