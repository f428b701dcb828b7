"""URL expressions: parts, keys, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and substrings of the filters.
ALLOW = (r"(/recipe/|/recipes/)", r"/recipe-", r"/recipes-", r"/cook/", r"/cooking/", r"/food/")
ADAPTIVE_ALLOW = (r"/recipe[s]?/", r"-recipe-", r"/cooking/", r"/food/", r"/meal[s]?/", r"/dish(es)?/")
ADAPTIVE_DENY = (r"/category/", r"/tag/", r"/author/", r"/about", r"/contact", r"/privacy", r"/search")
LIKELY = (r"/recipe/", r"/recipes/[^/]+$", r"-recipe\b", r"/[0-9]{4}/[0-9]{2}/[^/]+", r"\b(bake|cook|make|how-to)\b")
UNLIKELY = (r"/category/", r"/tag/", r"/recipes/?$", r"/collection/", r"/all-recipes")
PAYWALL = ("subscription", "premium", "members-only", "subscriber", "paid-content", "paywall", "register", "login-required")
RISKY_HOSTS = ("cookbooks.com", "chef-proprietary.com", "premium-recipes.com")
COPYRIGHT = ("cookbook", "professional-chef", "signature-recipe", "proprietary")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "fbclid", "gclid")
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
HTTP = r"^https?://[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}(?![A-Za-z0-9_])([-a-zA-Z0-9()@:%_+.~#?&/=]*)$"
PHOTOGRAPHY = ("professional-photography", "food-photography")
COMMENTARY = ("chef-story", "cooking-memoir")
BASIC = ("ingredients", "cooking-instructions", "recipe-basic", "simple-recipe")
# End of fixed values.


def any_of(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike("(?i)" + p)
    return out


def holds(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(F.lower(c), F.lit(p))
    return out


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))


def fingerprint(url: Column) -> Column:
    """Host and path; null for what isn't a URL."""
    return F.concat(host(url), path(url))


def without_dots(path_: Column) -> Column:
    """A path with its "." and ".." segments resolved."""
    parts = F.split(path_, "/")
    last = F.element_at(parts, -1)
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.lit(1), F.size(acc) - 1))
    done = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    folder = last.isin(".", "..")
    return F.array_join(F.when(folder, F.concat(done, F.array(F.lit("")))).otherwise(done), "/")


def absolute(url: Column, base: Column) -> Column:
    """``url`` as a browser resolves it on a page at ``base``; null if neither has a scheme and host."""
    scheme = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    own = F.substring(page, F.length(root) + 1, F.lit(1 << 20))
    at = F.when(own == "", F.lit("/")).otherwise(own)
    link, tail = F.regexp_extract(url, r"^[^?#]*", 0), F.regexp_extract(url, r"[?#].*$", 0)
    here = F.regexp_replace(at, "[^/]*$", "")
    resolved = (
        F.when(F.startswith(url, F.lit("//")), F.concat(F.regexp_extract(base, scheme, 0), url))
        .when(F.startswith(url, F.lit("/")), F.concat(root, without_dots(link), tail))
        .when(url == "", F.concat(root, at, F.regexp_extract(base, r"\?[^#]*", 0)))
        .when(F.startswith(url, F.lit("?")), F.concat(root, at, url))
        .when(F.startswith(url, F.lit("#")), F.concat(root, at, F.regexp_extract(base, r"\?[^#]*", 0), url))
        .otherwise(F.concat(root, without_dots(F.concat(here, link)), tail))
    )
    return F.when(url.rlike(scheme), url).when(root != "", resolved)


def cache_key(url: Column) -> Column:
    """The URL without tracking parameters, under a prefix."""
    names = "|".join(TRACKING)
    query = F.regexp_replace(url, rf"(?<=[?&])({names})=[^&#]*&?", "")
    return F.concat(F.lit("recipe:v2:"), F.regexp_replace(query, r"[?&](?=#|$)", ""))


def allowed(url: Column) -> Column:
    return any_of(url, ALLOW)


def adaptive(url: Column) -> Column:
    return any_of(url, ADAPTIVE_ALLOW) & ~any_of(url, ADAPTIVE_DENY)


def likely(url: Column) -> Column:
    return any_of(url, LIKELY) & ~any_of(url, UNLIKELY)


def source_type(url: Column) -> Column:
    c = lambda s: F.contains(url, F.lit(s))
    return F.when(c("instagram.com") | c("instagr.am"), "instagram").when(c("tiktok.com"), "tiktok").when(c("youtube.com") | c("youtu.be"), "youtube").otherwise("website")


def source_type_by_path(url: Column) -> Column:
    h, p = host(url), path(url)
    has = lambda c, s: F.contains(c, F.lit(s))
    return (
        F.when(has(h, "tiktok.com") & has(p, "/video/"), "tiktok")
        .when(has(h, "instagram.com") & (has(p, "/reel/") | has(p, "/p/")), "instagram")
        .when((has(h, "youtube.com") & (has(p, "/watch") | has(p, "/shorts/"))) | has(h, "youtu.be"), "youtube")
        .otherwise("website")
    )


def compliance(url: Column, honor_paywalls: bool = True, respect_copyrights: bool = True) -> Column:
    """can_scrape, warnings, restrictions by substrings of the URL.  A paywall ends the screen when honoured."""
    wall = holds(url, PAYWALL)
    restrictions = F.array_compact(F.array(
        F.when(wall & F.lit(honor_paywalls), "paywall"),
        F.when(~(wall & F.lit(honor_paywalls)) & holds(url, PHOTOGRAPHY), "photography"),
    ))
    go_on = ~(wall & F.lit(honor_paywalls))
    risky = go_on & holds(host(url), RISKY_HOSTS) & F.lit(respect_copyrights)
    warnings = F.array_compact(F.array(
        F.when(wall & F.lit(not honor_paywalls), "paywall"),
        F.when(risky, "copyrighted domain"),
        F.when(risky & holds(url, COPYRIGHT), "copyrighted descriptions"),
        F.when(go_on & holds(url, COMMENTARY), "commentary"),
        F.when(go_on & holds(url, BASIC), "basic"),
    ))
    return F.struct((F.size(restrictions) == 0).alias("can_scrape"), warnings.alias("warnings"), restrictions.alias("restrictions"))


def slug_title(url: Column) -> Column:
    from .text import capitalize_words

    found = F.lit("")
    for p in (r"(?i)/recipe[s]?/([a-z0-9-]+)", r"(?i)/([a-z0-9-]+)-recipe", r"(?i)/([a-z0-9-]+)$"):
        found = F.when(found != "", found).otherwise(F.regexp_extract(url, p, 1))
    return F.when(found == "", "Unknown Recipe").otherwise(capitalize_words(F.replace(found, F.lit("-"), F.lit(" "))))


def locations(xml: Column) -> Column:
    """The http(s) URLs in a sitemap's loc elements."""
    found = F.transform(F.regexp_extract_all(xml, F.lit("(?i)<loc>([^<]+)</loc>"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(found, lambda u: F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a[^>]+href="([^"]+)"'), F.lit(1))
