"""Queries over text, URL and number expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from .registry import query

LINE = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


def lines(t):
    return t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


def sql_swap(expr, table):
    for a, b in table.items():
        expr = f"replace({expr}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return expr


def sql_title(expr):
    return f"trim(regexp_replace(translate(translate({sql_swap(expr, T.FRACTIONS)}, '®™©℠', ''), '–—', '--'), '\\s+', ' ', 'g'))"


@query(f"""SELECT doc_id, line, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(translate({sql_swap(sql_swap('line', T.FRACTIONS), T.SUPERSCRIPTS)}, '®™©℠°∞‰§…•◦▪▫"''–—₁₂₃₄₅₆₇₈₉₀', ''),
  '(?i)\\b(brand)\\b', '', 'g'), '\\s+', ' ', 'g')), '\\s*,\\s*$', ''), '\\s*-\\s*$', '')) AS cleaned FROM ({LINE})""")
def ingredient_text_clean(t):
    return lines(t).select("doc_id", "line", F.trim(T.clean_ingredient(F.col("line"))).alias("cleaned"))


@query(f"SELECT doc_id, line, {sql_title('line')} AS cleaned FROM ({LINE})")
def title_text_clean(t):
    return lines(t).select("doc_id", "line", T.clean_title(F.col("line")).alias("cleaned"))


@query(f"SELECT conv_id, turn, {sql_title(sql_swap('text', T.SUPERSCRIPTS))} AS cleaned FROM conversations")
def instruction_text_clean(t):
    return t("conversations").select("conv_id", "turn", T.clean_instruction(F.col("text")).alias("cleaned"))


@query(f"SELECT page_id, {sql_swap('html', T.ENTITIES)} AS decoded FROM pages")
def html_entity_decode(t):
    return t("pages").select("page_id", T.decode_entities(F.col("html")).alias("decoded"))


@query("VALUES (1, 'café ' || chr(39) || ' ' || chr(31) || ' €'), (2, '<b>'), (3, NULL), (4, '')".replace("VALUES", "SELECT * FROM (VALUES") + ") v(id, decoded)")
def html_entity_numeric(t):
    rows = [(1, "caf&#233; &amp;#39; &#x1f; &#8364;"), (2, "&AMP;lt;b&gt;"), (3, None), (4, "")]
    return t.rows(rows, "id int, text string").select("id", T.decode_entities(F.col("text")).alias("decoded"))


@query(f"""SELECT doc_id, line, lower(regexp_replace(trim(line), '\\s+', ' ', 'g')) AS normalized,
  trim(regexp_replace(line, '<[^>]*>', '', 'g')) AS untagged FROM ({LINE})""")
def text_normalize(t):
    return lines(t).select("doc_id", "line", T.normalize(F.col("line")).alias("normalized"), T.strip_tags(F.col("line")).alias("untagged"))


@query("SELECT p_partkey, array_to_string([upper(w[1]) || w[2:] for w in string_split(p_name, ' ')], ' ') AS capital FROM part")
def capitalize_words(t):
    return t("part").select("p_partkey", T.capitalize_words(F.col("p_name")).alias("capital"))


@query("""SELECT doc_id, coalesce(list_max(n), 0.0) AS largest, len(n) AS n_numbers, len(f) AS n_fractions FROM (
  SELECT doc_id, [CAST(x AS DOUBLE) for x in regexp_extract_all(text, '[0-9]+\\.?[0-9]*')] AS n, regexp_extract_all(text, '[0-9]+/[0-9]+') AS f FROM documents)""")
def numbers_extracted(t):
    n = T.numbers(F.col("text"))
    return t("documents").select("doc_id", F.coalesce(F.array_max(n), F.lit(0.0)).alias("largest"), F.size(n).cast("long").alias("n_numbers"), F.size(T.fractions(F.col("text"))).cast("long").alias("n_fractions"))


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN w WHEN w = 'leaf' THEN 'leaves' WHEN w = 'knife' THEN 'knives' WHEN w = 'child' THEN 'children'
  WHEN regexp_matches(w, '(s|sh|ch)$') THEN w || 'es' ELSE w || 's' END AS plural FROM (SELECT p_partkey, p_size, split_part(p_name, ' ', 2) AS w FROM part)""")
def pluralized(t):
    return t("part").select("p_partkey", T.pluralize(F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_size")).alias("plural"))


TITLE_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), '[^A-Za-z0-9_\\s-]', '', 'g'), '\\s+', ' ', 'g'), '\\b(the|a|an)\\b', '', 'g'), '\\b(recipe|recipes)\\b', '', 'g'), '\\b(best|perfect|easy|simple|ultimate|classic)\\b', '', 'g'), 'ies$', 'y'), 's$', ''))"
FIRST = "split_part(text, chr(10), 1)"


@query(f"SELECT doc_id, {TITLE_KEY.format(FIRST)} AS title_key FROM documents")
def title_keys(t):
    return t("documents").select("doc_id", T.title_key(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title_key"))


@query(f"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({FIRST})), '[^A-Za-z0-9_\\s]', '', 'g'), '[0-9]+', '', 'g'), '\\s+', ' ', 'g'),
  '\\b(cup|cups|tablespoon|tablespoons|teaspoon|teaspoons|pound|pounds|ounce|ounces|gram|grams|kg|lb|oz|tsp|tbsp)\\b', '', 'g'), '\\b(fresh|dried|chopped|minced|diced|sliced|whole|ground)\\b', '', 'g')) AS item_key,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({FIRST})), '\\b(best|perfect|easy|simple|quick|homemade|classic|authentic|traditional)\\b', '', 'g'), '\\b(recipe|recipes)\\b', '', 'g'), '[^a-z0-9\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS name_key,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({FIRST})), '[^A-Za-z0-9_\\s-]', '', 'g'), '\\s+', ' ', 'g'), 'ies$', 'y'), 's$', '') AS source_key
  FROM documents""")
def match_keys(t):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return t("documents").select("doc_id", T.ingredient_key(first).alias("item_key"), T.name_key(first).alias("name_key"), T.source_key(first).alias("source_key"))


@query("SELECT * FROM (VALUES (1, '2 tablespoonsugar until done'), (2, 'bake 5 min. then rest'), (3, 'approximatelyone poundof it'), (4, NULL)) v(id, expanded)")
def abbreviation_expand(t):
    rows = [(1, "2 tbsp.sugar til done"), (2, "bake 5 min. then rest"), (3, "approx.one lb.of it"), (4, None)]
    return t.rows(rows, "id int, text string").select("id", T.expand(F.col("text")).alias("expanded"))


HALVES = {"1/2": "½", "1/3": "⅓", "1/4": "¼", "3/4": "¾", "2/3": "⅔"}
PUNCTUATED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s*,\s*', ', ', 'g'), '\s*\.\s*', '. ', 'g'), '\s*;\s*', '; ', 'g'), '\s*:\s*', ': ', 'g')"
DEGREES = rf"regexp_replace(regexp_replace({PUNCTUATED}, '([0-9]+)\s*°\s*([CF])\b', '\1°\2', 'g'), '(?i)([0-9]+)\s*degrees?\s*([CF])\b', '\1°\2', 'g')"


@query(rf"SELECT conv_id, turn, trim(regexp_replace(regexp_replace({sql_swap(DEGREES, HALVES)}, '([0-9]+)\s*-\s*([0-9]+)', '\1-\2', 'g'), '\s+', ' ', 'g')) AS normalized FROM conversations")
def instruction_normalize(t):
    return t("conversations").select("conv_id", "turn", T.normalize_instruction(F.col("text")).alias("normalized"))


@query("""WITH w AS (SELECT doc_id, word, min(i) AS i FROM (SELECT doc_id, unnest(s) AS word, generate_subscripts(s, 1) AS i FROM (
  SELECT doc_id, regexp_split_to_array(lower(trim(text, ' ' || chr(10) || chr(9))), '\\s+') AS s FROM documents)) GROUP BY ALL)
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM w GROUP BY doc_id""")
def word_dedup(t):
    return t("documents").select("doc_id", T.dedup_words(F.col("text")).alias("words"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '#([A-Za-z0-9_]+)', 1)) AS BIGINT) AS n_tags FROM documents")
def hashtag_count(t):
    return t("documents").select("doc_id", F.size(T.hashtags(F.col("text"))).cast("long").alias("n_tags"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_\\s.,!?-]', ' ', 'g'), '\\s+', ' ', 'g')) AS c FROM documents),
  s AS (SELECT doc_id, c, trim(left(c, 500)) AS s FROM c)
  SELECT doc_id, CASE WHEN length(c) <= 500 THEN c WHEN strpos(s, ' ') > 0 AND length(s) - strpos(reverse(s), ' ') > 400 THEN left(s, length(s) - strpos(reverse(s), ' ')) ELSE s END AS short FROM s""")
def truncate_at_word(t):
    return t("documents").select("doc_id", T.truncate(F.col("text"), "description").alias("short"))


@query("""WITH r AS (SELECT doc_id, lang, source, [x for x in [trim(y) for y in string_split(text, chr(10))] if x <> ''] AS l FROM documents)
  SELECT doc_id, concat_ws('. ', 'Title: ' || coalesce(l[1], ''), CASE WHEN coalesce(l[2], '') <> '' THEN 'Desc: ' || left(l[2], 150) END,
  CASE WHEN array_to_string([split_part(x, ',', 1) for x in l[1:7]], ', ') <> '' THEN 'Ingredients: ' || array_to_string([split_part(x, ',', 1) for x in l[1:7]], ', ') END, 'Tags: ' || lang || ', ' || source) AS bundle FROM r""")
def embedding_bundle(t):
    l = T.lines(F.col("text"))
    return t("documents").select("doc_id", T.bundle(F.get(l, 0), F.get(l, 1), l, F.array("lang", "source")).alias("bundle"))


@query(f"SELECT doc_id, array_to_string([x for x in [trim(y) for y in string_split({FIRST}, ',')] if x <> ''], '|') AS parts FROM documents")
def comma_list(t):
    return t("documents").select("doc_id", F.array_join(T.split_list(F.split_part("text", F.lit("\n"), F.lit(1))), "|").alias("parts"))


@query("""WITH l AS (SELECT doc_id, trim(x) AS x, i FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
  d AS (SELECT doc_id, x, min(i) AS i FROM l WHERE x <> '' GROUP BY ALL) SELECT d.doc_id, string_agg(x, chr(10) ORDER BY i) AS lines, count(*) AS n FROM d GROUP BY doc_id""")
def line_dedup(t):
    l = T.distinct_lines(F.col("text"))
    return t("documents").where(F.size(l) > 0).select("doc_id", F.array_join(l, "\n").alias("lines"), F.size(l).cast("long").alias("n"))


WORDS = ("the", "und", "que", "les")
SQL_WORDS = "['the', 'und', 'que', 'les']"


@query(f"""SELECT doc_id, array_to_string([s for s in [trim(y) for y in regexp_split_to_array(text, '[.!?]+')] if s <> '' AND (contains(lower(s), 'the') OR contains(lower(s), 'und'))], '. ') AS kept FROM documents""")
def sentences_with_keyword(t):
    return t("documents").select("doc_id", T.sentences_with(F.col("text"), ("the", "und")).alias("kept"))


@query(f"SELECT doc_id, round((CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'und') AS INT) + CAST(contains(lower(text), 'que') AS INT) + CAST(contains(lower(text), 'les') AS INT)) / 4.0, 6)::DOUBLE AS relevance FROM documents")
def relevance_filter(t):
    return t("documents").select("doc_id", F.round(T.relevance(F.col("text"), WORDS), 6).cast("double").alias("relevance"))


@query(f"""SELECT doc_id, count(*) FILTER (length(line) BETWEEN 3 AND 200 AND regexp_matches(line, '^[0-9]+|^[•*-]|(?i)[0-9]+\\s*(cup|tbsp|tsp|oz|lb|g|kg|ml|l|teaspoon|tablespoon|pound|ounce|gram)|(?i)^(a|an|the)\\s+[A-Za-z0-9_]+')) AS items,
  count(*) FILTER (length(line) BETWEEN 10 AND 500 AND regexp_matches(line, '(?i)^[0-9]+[.)]\\s*|^(first|second|third|then|next|finally)|^[•*-]|^(heat|cook|bake|mix|stir|add|pour|place|cut|chop|slice|dice|sauté|fry)')) AS steps,
  count(*) FILTER (length(line) < 5 OR regexp_matches(line, '(?i)^(ingredients?|instructions?|directions?|method|steps?):?\\s*$')) AS headers FROM ({LINE}) GROUP BY doc_id""")
def line_classifier(t):
    c = F.col("line")
    return lines(t).groupBy("doc_id").agg(F.count_if(T.item_line(c)).alias("items"), F.count_if(T.step_line(c)).alias("steps"), F.count_if(T.header_line(c)).alias("headers"))


SAID = "(" + " OR ".join("regexp_matches(s, '" + p.replace("'", "''") + "')" for p in T.NOT_ITEMS) + ")"


@query(f"""SELECT doc_id, line, coalesce(s <> '' AND NOT (length(s) <= 2 AND NOT regexp_matches(s, '{T.SHORT_ITEMS}')) AND NOT {SAID} AND regexp_matches(s, '[a-zA-Z]') AND length(regexp_replace(s, '[^a-zA-Z0-9]', '', 'g')) / length(s) >= 0.5
  AND NOT (length(s) > 3 AND len(list_distinct(string_split(regexp_replace(lower(s), '\\s', '', 'g'), ''))) <= 2), false) AS valid FROM (SELECT doc_id, line, trim(line) AS s FROM ({LINE}))""")
def line_validity(t):
    return lines(t).select("doc_id", "line", T.valid_line(F.col("line")).alias("valid"))


@query("""SELECT doc_id, count(*) FILTER (u <> '') AS n_steps, max(i) FILTER (u <> '') AS last_step FROM (
  SELECT doc_id, trim(regexp_replace(trim(x), '^([-*•]|[0-9]+[.)])\\s*', '')) AS u, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
    SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE trim(x) <> '' AND NOT starts_with(trim(x), '#')) GROUP BY doc_id HAVING count(*) FILTER (u <> '') > 0""")
def list_from_text(t):
    s = T.step_list(F.col("text"))
    return t("documents").select("doc_id", s.alias("s")).where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n_steps"), F.array_max("s.step_number").cast("long").alias("last_step"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM pages")
def url_parts(t):
    return t("pages").select("page_id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))


@query("""SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^?#]+)', 1) ORDER BY page_id) AS n FROM pages) WHERE n = 1""")
def url_fingerprint_dedup(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(U.fingerprint(F.col("url"))).orderBy("page_id"))
    return t("pages").select("page_id", n.alias("n")).where("n = 1").select("page_id")


@query("SELECT page_id, 'recipe:v2:' || regexp_replace(regexp_replace(url, '([?&])(utm_source|utm_medium|utm_campaign|utm_content|fbclid|gclid)=[^&#]*&?', '\\1', 'g'), '[?&](#|$)', '\\1') AS key FROM pages")
def url_cache_key(t):
    return t("pages").select("page_id", U.cache_key(F.col("url")).alias("key"))


@query("""SELECT page_id, regexp_matches(url, '(?i)(/recipe/|/recipes/)|/recipe-|/recipes-|/cook/|/cooking/|/food/') AS allowed,
  regexp_matches(url, '(?i)/recipe[s]?/|-recipe-|/cooking/|/food/|/meal[s]?/|/dish(es)?/') AND NOT regexp_matches(url, '(?i)/category/|/tag/|/author/|/about|/contact|/privacy|/search') AS adaptive,
  regexp_matches(url, '(?i)/recipe/|/recipes/[^/]+$|-recipe\\b|/[0-9]{4}/[0-9]{2}/[^/]+|\\b(bake|cook|make|how-to)\\b') AND NOT regexp_matches(url, '(?i)/category/|/tag/|/recipes/?$|/collection/|/all-recipes') AS likely FROM pages""")
def url_filter_allow_deny(t):
    u = F.col("url")
    return t("pages").select("page_id", U.allowed(u).alias("allowed"), U.adaptive(u).alias("adaptive"), U.likely(u).alias("likely"))


@query("""SELECT page_id, NOT (wall OR contains(l, 'professional-photography') OR contains(l, 'food-photography')) AS can_scrape,
  CASE WHEN NOT wall AND (contains(l, 'chef-story') OR contains(l, 'cooking-memoir')) THEN 1 ELSE 0 END + CASE WHEN NOT wall AND (contains(l, 'ingredients') OR contains(l, 'cooking-instructions') OR contains(l, 'recipe-basic') OR contains(l, 'simple-recipe')) THEN 1 ELSE 0 END AS n_warnings
  FROM (SELECT page_id, lower(url) AS l, regexp_matches(lower(url), 'subscription|premium|members-only|subscriber|paid-content|paywall|register|login-required') AS wall FROM pages)""")
def url_compliance(t):
    c = t("pages").select("page_id", U.compliance(F.col("url")).alias("c"))
    return c.select("page_id", "c.can_scrape", F.size("c.warnings").alias("n_warnings"))


@query("SELECT page_id, CASE WHEN contains(url, 'instagram.com') OR contains(url, 'instagr.am') THEN 'instagram' WHEN contains(url, 'tiktok.com') THEN 'tiktok' WHEN contains(url, 'youtube.com') OR contains(url, 'youtu.be') THEN 'youtube' ELSE 'website' END AS kind, 'website' AS kind_by_path FROM pages")
def source_type_split(t):
    return t("pages").select("page_id", U.source_type(F.col("url")).alias("kind"), U.source_type_by_path(F.col("url")).alias("kind_by_path"))


@query("SELECT page_id, regexp_matches(url, '^https?://[-a-zA-Z0-9@:%._+~#=]{1,256}\\.[a-zA-Z0-9()]{1,6}\\b([-a-zA-Z0-9()@:%_+.~#?&/=]*)$') AS is_url, false AS is_uuid, false AS is_email FROM pages")
def url_validation(t):
    u = F.col("url")
    return t("pages").select("page_id", u.rlike(U.HTTP).alias("is_url"), u.rlike(U.UUID).alias("is_uuid"), u.rlike(U.EMAIL).alias("is_email"))


@query("""SELECT page_id, CASE WHEN slug = '' THEN 'Unknown Recipe' ELSE array_to_string([upper(w[1]) || w[2:] for w in string_split(replace(slug, '-', ' '), ' ')], ' ') END AS title
  FROM (SELECT page_id, coalesce(nullif(regexp_extract(url, '(?i)/recipe[s]?/([a-z0-9-]+)', 1), ''), nullif(regexp_extract(url, '(?i)/([a-z0-9-]+)-recipe', 1), ''), regexp_extract(url, '(?i)/([a-z0-9-]+)$', 1)) AS slug FROM pages)""")
def slug_title(t):
    return t("pages").select("page_id", U.slug_title(F.col("url")).alias("title"))


# DuckDB has no fold with an index over unequal steps, so ".." goes by the pattern, a segment before it at a time.
RESOLVED = """CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN link WHEN root = '' THEN NULL WHEN starts_with(link, '//') THEN regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') || link
  WHEN starts_with(link, '?') THEN root || page_path || link WHEN starts_with(link, '#') OR link = '' THEN root || page_path || regexp_extract(url, '[?][^#]*') || link
  ELSE root || regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN starts_with(link, '/') THEN '' ELSE regexp_replace(page_path, '[^/]*$', '') END || regexp_extract(link, '^[^?#]*'), '/[.](/|$)', '/', 'g'), '/[^/]+/[.][.](/|$)', '/'), '/[^/]+/[.][.](/|$)', '/'), '^(/[.][.])+(/|$)', '/') || regexp_extract(link, '[?#].*$') END"""


@query(f"""SELECT page_id, i - 1 AS ord, {RESOLVED} AS target FROM (SELECT *, CASE WHEN substr(regexp_replace(url, '[?#].*$', ''), length(root) + 1) = '' THEN '/' ELSE substr(regexp_replace(url, '[?#].*$', ''), length(root) + 1) END AS page_path
  FROM (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a[^>]+href="([^"]+)"', 1) AS l FROM pages)))""")
def link_extract(t):
    found = t("pages").select("page_id", "url", F.posexplode(U.links(F.col("html"))).alias("ord", "link"))
    return found.select("page_id", F.col("ord").cast("long").alias("ord"), U.absolute(F.col("link"), F.col("url")).alias("target"))


@query("SELECT id, loc FROM (VALUES (1, '<urlset><url><loc> https://a.com/x </loc></url><url><loc>ftp://b</loc></url></urlset>'), (2, 'junk<LOC>http://c.org</LOC>'), (3, '')) v(id, xml) LEFT JOIN LATERAL (SELECT trim(l) AS loc FROM (SELECT unnest(regexp_extract_all(xml, '(?i)<loc>([^<]+)</loc>', 1)) AS l) WHERE regexp_matches(trim(l), '^https?://')) ON true")
def sitemap_locations(t):
    rows = [(1, "<urlset><url><loc> https://a.com/x </loc></url><url><loc>ftp://b</loc></url></urlset>"), (2, "junk<LOC>http://c.org</LOC>"), (3, "")]
    return t.rows(rows, "id int, xml string").select("id", F.explode_outer(U.locations(F.col("xml"))).alias("loc"))


Q = "(VALUES (1, '1/2'), (2, '1 1/2'), (3, '2'), (4, '0.75'), (5, 'two'), (6, ''), (7, '3/4'), (8, '10')) q(id, s)"


@query(f"""SELECT id, round(CASE WHEN regexp_matches(s, '^[0-9]+ [0-9]+/[0-9]+$') THEN 1.5 WHEN s LIKE '%/%' THEN CAST(split_part(s, '/', 1) AS DOUBLE) / CAST(split_part(s, '/', 2) AS DOUBLE) ELSE coalesce(try_cast(s AS DOUBLE), 0) END, 6) AS mixed_first,
  round(CASE WHEN s LIKE '%/%' THEN CAST(regexp_extract(s, '([0-9]+)/', 1) AS DOUBLE) / CAST(split_part(s, '/', 2) AS DOUBLE) ELSE coalesce(try_cast(s AS DOUBLE), 0) END, 6) AS simple_first FROM {Q}""")
def fraction_variants(t):
    rows = [(1, "1/2"), (2, "1 1/2"), (3, "2"), (4, "0.75"), (5, "two"), (6, ""), (7, "3/4"), (8, "10")]
    s = F.col("s")
    return t.rows(rows, "id int, s string").select("id", F.round(N.fraction(s), 6).alias("mixed_first"), F.round(N.fraction_simple_first(s), 6).alias("simple_first"))


DURATIONS = [("PT15M", 15, 15, 15, 15), ("PT1H30M", 90, 90, 90, 90), ("P0Y0M0DT0H20M0.000S", 20, 20, 20, 20), ("P1D", 1440, 1440, None, 1), ("2h 30m", 2, 2, 150, 150), ("90", 90, 90, None, 90), ("", None, None, None, None), ("1 hour 5 minutes", 1, 65, 65, 65)]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL::BIGINT" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::BIGINT" for x in row) + ")" for row in DURATIONS) + ") d(s, iso, iso_or_text, plain, edge)")
def duration_parse(t):
    s = F.col("s")
    return t.rows([(r[0],) for r in DURATIONS], "s string").select("s", N.iso_minutes(s).alias("iso"), N.iso_or_text_minutes(s).alias("iso_or_text"), N.text_minutes(s).alias("plain"), N.edge_minutes(s).alias("edge"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN m < 60 THEN m || 'm' WHEN m % 60 = 0 THEN (m // 60) || 'h' ELSE (m // 60) || 'h ' || (m % 60) || 'm' END AS label FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 7 AS BIGINT) AS m FROM lineitem)")
def duration_format(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 7).cast("long").alias("m"))
    return rows.select("l_orderkey", "l_linenumber", N.format_minutes(F.col("m")).alias("label"))


TIMES = [(1, "bake for 20 to 25 minutes at 350°F, rest 2 hours"), (2, "about 5 mins then 5 min, 180 C"), (3, "no time"), (4, None), (5, "1 hr 30 minutes"), (6, "90 mins - 2 hours; 10-15 minutes")]


@query(r"""SELECT id, array_to_string(list_sort(list_distinct([x::BIGINT for x in regexp_extract_all(s, '(?i)([0-9]+)(?:\s*(?:to|-)\s*[0-9]+)?\s*(?:minutes?|mins?)', 1)] || [x::BIGINT for x in regexp_extract_all(s, '(?i)[0-9]+\s*(?:to|-)\s*([0-9]+)\s*(?:minutes?|mins?)', 1)]
  || [x::BIGINT * 60 for x in regexp_extract_all(s, '(?i)([0-9]+)(?:\.[0-9]+)?\s*(?:hours?|hrs?)', 1)]))[1:2], ',') AS timers, CASE WHEN regexp_matches(s, '([0-9]+)\s*°?\s*([CFcf])') THEN regexp_extract(s, '([0-9]+)\s*°?\s*([CFcf])', 1) || upper(regexp_extract(s, '([0-9]+)\s*°?\s*([CFcf])', 2)) END AS temperature
  FROM (VALUES """ + ", ".join(f"({i}, {'NULL' if x is None else chr(39) + x + chr(39)})" for i, x in TIMES) + ") v(id, s)")
def timers_extract(t):
    degrees = N.temperature(F.col("text"))
    return t.rows(TIMES, "id int, text string").select("id", F.array_join(N.timers(F.col("text")), ",").alias("timers"), F.concat(degrees["value"].cast("string"), degrees["unit"]).alias("temperature"))


@query("SELECT o_orderkey, greatest(least(o_totalprice, 100000.0), 1000.0) AS clamped, CASE WHEN o_totalprice >= 1000000 THEN printf('%.1fM', floor(o_totalprice / 100000 + 0.5) / 10) WHEN o_totalprice >= 1000 THEN printf('%.1fK', floor(o_totalprice / 100 + 0.5) / 10) ELSE 'small' END AS label, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS rounded FROM orders")
def number_helpers(t):
    c = F.col("o_totalprice")
    return t("orders").select("o_orderkey", N.clamp(c, 1000.0, 100000.0).alias("clamped"), F.when(c < 1000, "small").otherwise(N.human(c)).alias("label"), N.half_up(c).alias("rounded"))


@query("SELECT p_partkey, left(md5(lower(trim(p_name))), 12) AS id FROM part")
def md5_id(t):
    return t("part").select("p_partkey", N.short_md5(F.col("p_name")).alias("id"))


@query("""WITH RECURSIVE h(page_id, url, i, v) AS (SELECT page_id, url, 0, 0::BIGINT FROM pages UNION ALL
  SELECT page_id, url, i + 1, ((v * 31 + ascii(url[i + 1]) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 FROM h WHERE i < length(url))
  SELECT page_id, abs(v) AS hash FROM h WHERE i = length(url)""")
def url_rolling_hash(t):
    return t("pages").select("page_id", N.rolling_hash(F.col("url")).alias("hash"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * 240.0 * 0.6, 6) AS first_grams, round((l_quantity + l_quantity * 2) / 2 * 28.3495, 6) AS mean_grams, round(l_quantity * 100.0, 6) AS unknown_grams FROM lineitem""")
def unit_to_grams(t):
    q = F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(N.grams(q, q * 2, F.lit("cups"), F.lit(0.6)), 6).alias("first_grams"), F.round(N.grams(q, q * 2, F.lit("oz."), F.lit(0.6), "mean"), 6).alias("mean_grams"), F.round(N.grams(q, q, F.lit("sprig"), F.lit(1.0), "max", 100.0), 6).alias("unknown_grams"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CASE o_orderstatus WHEN 'F' THEN 90 WHEN 'O' THEN 180 ELSE 365 END, '%Y-%m-%d') AS delete_on FROM orders")
def retention_date(t):
    days = F.when(F.col("o_orderstatus") == "F", 90).when(F.col("o_orderstatus") == "O", 180).otherwise(365)
    return t("orders").select("o_orderkey", F.date_format(F.date_add(F.to_date("o_orderdate"), days), "yyyy-MM-dd").alias("delete_on"))


@query("SELECT page_id, lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, regexp_extract(html, '<meta name=\"description\" content=\"([^\"]*)\"', 1) AS description, regexp_extract(html, '<meta property=\"og:image\" content=\"([^\"]*)\"', 1) AS image FROM pages")
def page_title_meta(t):
    g = lambda p: F.regexp_extract("html", p, 1)
    return t("pages").select("page_id", F.lower(g("(?is)<title>(.*?)</title>")).alias("title"), g('<meta name="description" content="([^"]*)"').alias("description"), g('<meta property="og:image" content="([^"]*)"').alias("image"))
