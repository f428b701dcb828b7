"""Fields read from text and feeds: nutrients, times, robots rules, sitemap entries, completeness of a reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_up
from .urls import absolute, likely

# Nutrients in grams and in milligrams, sizes, equipment, feeds of a site, links of a home page.
IN_GRAMS = ("protein", "carbohydrate", "fat", "saturated_fat", "fiber", "sugar")
IN_MILLIGRAMS = ("cholesterol", "sodium")
SIZES = ("Bytes", "KB", "MB", "GB")
EQUIPMENT = (
    "oven", "stove", "stovetop", "microwave", "grill", "barbecue", "pan", "pot", "skillet", "saucepan", "stockpot", "dutch oven", "bowl", "mixing bowl", "serving bowl", "plate", "dish",
    "whisk", "spatula", "wooden spoon", "ladle", "tongs", "knife", "cutting board", "chopping board", "blender", "food processor", "mixer", "stand mixer", "hand mixer", "measuring cup",
    "measuring spoons", "baking sheet", "baking pan", "cake pan", "muffin tin", "cookie sheet",
)
FEEDS = ("https://{0}/feed/", "https://{0}/rss/", "https://{0}/feeds/recipes.xml", "https://{0}/category/recipes/feed/", "https://www.{0}/feed/", "https://www.{0}/rss.xml")
SITEMAPS = ("https://{0}/post-sitemap.xml", "https://{0}/recipe-sitemap.xml", "https://{0}/wp-sitemap-posts-post-1.xml", "https://{0}/sitemap_index.xml", "https://{0}/sitemap-misc.xml", "https://{0}/page-sitemap.xml", "https://www.{0}/recipe-sitemap.xml", "https://www.{0}/post-sitemap.xml")
HOME_LINKS = (r"""(?i)href=["']([^"']*/recipe/[^"']+)["']""", r"""(?i)href=["']([^"']*/recipes/[^"'/]+)["']""", r"""(?i)href=["']([^"']*[a-z-]+-recipe[^"']*)["']""", r"""(?i)href=["']([^"']*/[0-9]{4}/[0-9]{2}/[^"']+)["']""")
LEAST = {"text": 11, "items": 3, "steps": 3, "confidence": 0.7, "score": 0.7}
# End of fixed values.

STRINGS = "array<string>"


def gram_value(c: Column) -> Column:
    """The number that is left at the beginning without blanks and the letter g; null for none."""
    return F.regexp_extract(F.regexp_replace(F.lower(c), r"[g\s]", ""), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double")


def number_value(c: Column) -> Column:
    """The first number, whatever its unit."""
    return F.regexp_extract(c, r"[0-9]+\.?[0-9]*", 0).try_cast("double")


def nutrients(given: dict[str, Column]) -> dict[str, Column]:
    """Texts to numbers, in grams: milligrams are divided, a zero of them being none."""
    out = {k: gram_value(given[k]) for k in IN_GRAMS if k in given}
    for k in IN_MILLIGRAMS:
        if k in given:
            n = number_value(given[k])
            out[k] = F.when(n != 0, n / 1000)
    if "calories" in given:
        out["calories"] = number_value(given["calories"])
    return out


def plausible(n: dict[str, Column]) -> dict[str, Column]:
    """Without negative amounts; what is too much for grams was milligrams."""
    out = dict(n)
    for k in ("calories", "protein", "fat", "carbohydrate"):
        if k in n:
            out[k] = F.when(n[k] >= 0, n[k])
    for k, most in (("sodium", 10), ("cholesterol", 1)):
        if k in n:
            out[k] = F.when(n[k] > most, n[k] / 1000).otherwise(n[k])
    return out


def step_minutes(text: Column) -> Column:
    """All minutes that a step names, ends of ranges too, each once, in order; zero isn't one."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"(?i)([0-9]+)(?:\s*(?:to|-)\s*[0-9]+)?\s*(?:minutes?|mins?)", r"(?i)[0-9]+\s*(?:to|-)\s*([0-9]+)\s*(?:minutes?|mins?)")]
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(*found), lambda x: x.cast("long")), lambda x: x != 0)))


def kind_minutes(text: Column, kind: str) -> Column:
    """Minutes of "prep", "cook" or "total": minutes, hours and minutes with a colon, or in words; the first form that the text has."""
    out = None
    for form in (r"(?:min|mins?|minutes?)", r":([0-9]{1,2})", r"(?:h|hr|hrs|hour|hours)\s*([0-9]{1,3})?\s*(?:min|mins?|minutes?)?"):
        for name in (rf"{kind}\s*time\s*:?\s*", rf"{kind}\s*:?\s*"):
            p = "(?i)" + name + (r"([0-9]{1,2})" if form.startswith(":") else r"([0-9]{1,3})") + (form if form.startswith(":") else r"\s*" + form)
            a = F.regexp_extract(text, p, 1).try_cast("long")
            value = a if form.startswith("(?:min") else a * 60 + F.coalesce(F.regexp_extract(text, p, 2).try_cast("long"), F.lit(0))
            found = F.when(text.rlike(p), value)
            out = found if out is None else F.coalesce(out, found)
    return out


def human_bytes(n: Column) -> Column:
    power = sum((F.when(n >= 1024**k, 1).otherwise(0) for k in range(1, len(SIZES))), F.lit(0))
    value = half_up(n / F.pow(F.lit(1024.0), power) * 100) / 100
    text = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return F.concat(text, F.lit(" "), F.get(F.array(*map(F.lit, SIZES)), power))


def sitemap_entries(xml: Column) -> Column:
    """kind (index, urlset or loc), loc and lastmod of each http(s) entry; what comes before the document doesn't count."""
    body = F.regexp_extract(F.regexp_replace(xml, "^[\\s﻿\x00-\x1f\x7f-\x9f]+", ""), r"(?is)(?:<\?xml|<urlset|<sitemapindex).*", 0)
    clean = F.when(body != "", body).otherwise(xml)
    part = lambda x, tag: F.trim(F.regexp_extract(x, rf"(?is)<{tag}>\s*([^<]+?)\s*</{tag}>", 1))

    def entries(kind: str, pieces: Column) -> Column:
        made = F.transform(pieces, lambda x: F.struct(F.lit(kind).alias("kind"), part(x, "loc").alias("loc"), F.nullif(part(x, "lastmod"), F.lit("")).alias("lastmod")))
        return F.filter(made, lambda e: e["loc"].rlike("^https?://[^/]"))

    every = lambda p: F.regexp_extract_all(clean, F.lit(p), F.lit(0))
    index, urls = every("(?is)<sitemap>.*?</sitemap>"), every("(?is)<url>.*?</url>")
    return F.when(clean.rlike("(?i)<sitemapindex") & (F.size(index) > 0), entries("index", index)).when(clean.rlike("(?i)<urlset") & (F.size(urls) > 0), entries("urlset", urls)).otherwise(entries("loc", every("(?is)<loc>[^<]+</loc>")))


def robots_rules(text: Column) -> Column:
    """Rules of a robots file: agent, allow, path.  Agents in a row share the rules after them."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    start = F.struct(F.array().cast(STRINGS).alias("agents"), F.lit(True).alias("naming"), F.array().cast("array<struct<agent: string, allow: boolean, path: string>>").alias("rules"))

    def step(acc: Column, line: Column) -> Column:
        name, value = F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace(line, "^[^:]*:", ""))
        named = F.struct(F.when(acc["naming"], F.concat(acc["agents"], F.array(F.lower(value)))).otherwise(F.array(F.lower(value))).alias("agents"), F.lit(True).alias("naming"), acc["rules"].alias("rules"))
        more = F.transform(acc["agents"], lambda a: F.struct(a.alias("agent"), (name == "allow").alias("allow"), value.alias("path")))
        ruled = F.struct(acc["agents"].alias("agents"), F.lit(False).alias("naming"), F.concat(acc["rules"], more).alias("rules"))
        return F.when(name == "user-agent", named).when(name.isin("allow", "disallow") & (value != ""), ruled).otherwise(acc)

    return F.filter(F.aggregate(lines, start, step)["rules"], lambda r: r["path"] != "")


def robots_allowed(text: Column, path: Column, agent: str) -> Column:
    """Whether the agent may fetch the path: the longest rule of its own group, or else of "*", an allowing one first; no file, no rule."""
    rules = robots_rules(F.coalesce(text, F.lit("")))
    own = F.filter(rules, lambda r: F.contains(F.lit(agent.lower()), r["agent"]) & (r["agent"] != "*"))
    used = F.when(F.size(own) > 0, own).otherwise(F.filter(rules, lambda r: r["agent"] == "*"))

    def fits(r: Column) -> Column:
        quoted = F.regexp_replace(r["path"], r"[.+?()\[\]{}|^\\]", r"\\$0")
        return F.regexp_like(path, F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*")))

    best = F.array_max(F.transform(F.filter(used, fits), lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def feed_links(xml: Column, most: int = 50) -> Column:
    """Links of a feed that look like pages wanted, the first ``most``."""
    found = F.transform(F.regexp_extract_all(xml, F.lit("(?i)<link>([^<]+)</link>"), F.lit(1)), lambda x: F.trim(x))
    return F.slice(F.filter(found, lambda u: likely(u)), 1, most)


def home_links(html: Column, base: Column, most: int = 30) -> Column:
    """Links of a home page by pattern, resolved, each once, the first ``most``."""
    found = F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in HOME_LINKS))
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda u: absolute(u, base)), lambda u: u.isNotNull() & likely(u))), 1, most)


def guesses(host: Column, templates: tuple[str, ...]) -> Column:
    return F.array(*(F.concat(*(x for k, part in enumerate(t.split("{0}")) for x in ([F.lit(part)] if not k else [host, F.lit(part)]))) for t in templates))


def equipment(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), w) for w in EQUIPMENT)))


def completeness(text: Column, items: Column, steps: Column, confidence: Column) -> Column:
    """Score of a reading, whether it is valid, and what is missing."""
    tests = ((F.length(text) >= LEAST["text"], 2, "text"), (F.size(items) >= LEAST["items"], 3, "items"), (F.size(steps) >= LEAST["steps"], 3, "steps"), (confidence >= LEAST["confidence"], 2, "confidence"))
    tests = [(F.coalesce(ok, F.lit(False)), n, name) for ok, n, name in tests]
    tenths = sum((F.when(ok, n).otherwise(0) for ok, n, _ in tests), F.lit(0))
    return F.struct((tenths / 10).alias("score"), (tenths >= 7).alias("valid"), F.array_compact(F.array(*(F.when(~ok, name) for ok, _, name in tests))).alias("issues"))
