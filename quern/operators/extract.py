"""Records from pages: structured blocks by JSON functions, microdata and heuristics by the standard parser.

The parser runs over Arrow batches, one page at a time; everything else is a
column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N

BLOCK = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def blocks(html: Column) -> Column:
    """The JSON-LD blocks that parse, control characters out."""
    texts = F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1))
    return F.filter(F.transform(texts, lambda x: F.try_parse_json(F.regexp_replace(x, r"[\x00-\x1f]|\\[nrt]", " "))), lambda v: v.isNotNull())


def _items(v: Column) -> Column:
    """A block's objects: of an array, of a graph, or itself."""
    text = F.to_json(v)
    as_list = lambda j: F.from_json(j, "array<variant>")
    graph = F.try_variant_get(v, "$['@graph']", "string")
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), as_list(text)).when(graph.isNotNull(), as_list(graph)).otherwise(F.array(v))


def _typed(v: Column, kind: str) -> Column:
    named = F.try_variant_get(v, "$['@type']", "string")
    return F.coalesce(named.rlike(rf'(?i)(^|["\[, ]){kind}(["\], ]|$)'), F.lit(False))


def first_object(html: Column, kind: str = "Recipe") -> Column:
    """The first object of the type, as a variant."""
    return F.get(F.filter(F.flatten(F.transform(blocks(html), _items)), lambda v: _typed(v, kind)), 0)


def _text(v: Column, *paths: str) -> Column:
    return F.coalesce(*(F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths))


def _list(v: Column, path: str) -> Column:
    raw = F.try_variant_get(v, path, "string")
    return F.coalesce(F.from_json(raw, "array<string>"), F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>"))


def record(v: Column) -> Column:
    """The common fields of a structured object."""
    yields = F.regexp_extract_all(_text(v, "$.recipeYield"), F.lit("[0-9]+"), F.lit(0))
    most = F.array_max(F.transform(yields, lambda x: x.cast("int")))
    servings = F.when(most.isNotNull(), F.greatest(F.least(most, F.lit(50)), F.lit(1))).otherwise(4)
    steps = F.transform(_list(v, "$.recipeInstructions"), lambda s: F.coalesce(F.get_json_object(s, "$.text"), s))
    return F.struct(
        _text(v, "$.name", "$.headline").alias("title"), _text(v, "$.description").alias("description"), _text(v, "$.image.url", "$.image[0].url", "$.image[0]", "$.image").alias("image_url"),
        servings.alias("servings"), N.iso_minutes(_text(v, "$.prepTime")).alias("prep"), N.iso_minutes(_text(v, "$.cookTime")).alias("cook"), N.iso_minutes(_text(v, "$.totalTime")).alias("total"),
        _list(v, "$.recipeIngredient").alias("items"), steps.alias("steps"), _text(v, "$.author.name", "$.author[0].name", "$.author[0]", "$.author").alias("author"),
    )


class _Page(HTMLParser):
    """Texts by itemprop, and list items, paragraphs, headings and metas."""

    VOID = {"meta", "link", "img", "br", "input", "hr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.props: dict[str, list[str]] = {}
        self.parts: dict[str, list[str]] = {"h1": [], "title": [], "li": [], "p": []}
        self.metas: dict[str, str] = {}
        self.open: list[tuple[str, str | None, list[str]]] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("p", "li") and any(name == tag for name, _, _ in self.open):
            self.handle_endtag(tag)
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "meta" and a.get("content"):
            self.metas.setdefault(a.get("name") or a.get("property") or a.get("itemprop") or "", a["content"])
        if tag in self.VOID:
            if a.get("itemprop"):
                self.props.setdefault(a["itemprop"], []).append(a.get("content") or a.get("src") or a.get("href") or "")
            return
        if tag in self.parts or a.get("itemprop"):
            self.open.append((tag, a.get("itemprop"), []))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        for n in range(len(self.open) - 1, -1, -1):
            if self.open[n][0] == tag:
                for name, prop, texts in self.open[n:]:
                    text = " ".join("".join(texts).split())
                    if prop and text:
                        self.props.setdefault(prop, []).append(text)
                    if name in self.parts and text:
                        self.parts[name].append(text)
                del self.open[n:]
                return

    def close(self) -> None:
        super().close()
        while self.open:
            self.handle_endtag(self.open[0][0])

    def handle_data(self, data: str) -> None:
        if not self.skip:
            for _, _, texts in self.open:
                texts.append(data)


def parse(html: str | None) -> dict:
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except AssertionError:  # the parser gives up on some broken declarations; what it read before counts
        while page.open:
            page.handle_endtag(page.open[0][0])
    first = lambda *lists: next((x[0] for x in lists if x), None)
    return {
        "title": first(page.props.get("name"), page.parts["h1"], page.parts["title"]),
        "description": first(page.props.get("description"), [page.metas["description"]] if "description" in page.metas else None),
        "author": first(page.props.get("author"), [page.metas["author"]] if "author" in page.metas else None),
        "items": page.props.get("recipeIngredient") or page.parts["li"],
        "steps": page.props.get("recipeInstructions") or page.parts["p"],
        "method": "microdata" if page.props.get("recipeIngredient") else "generic",
    }


PARSED = "title string, description string, author string, items array<string>, steps array<string>, method string"


def parsed(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Microdata, else headings, list items and paragraphs of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([parse(x) for x in batch[html]], columns=[x.split()[0] for x in PARSED.split(", ")])
            out.insert(0, key, batch[key].to_numpy())
            yield out

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, {PARSED}")


def author(html: Column, url: Column, sites: dict[str, str]) -> Column:
    """By structured block, meta element, byline, then the site's own name."""
    from ..functions.urls import host

    byline = F.regexp_extract(html, r"(?i)\bby\s+([A-Z][a-z]+(?: [A-Z][a-z]+)+)", 1)
    meta = F.regexp_extract(html, '<meta name="author" content="([^"]*)"', 1)
    site = F.element_at(F.create_map(*(F.lit(x) for kv in sites.items() for x in kv)), host(url)) if sites else F.lit(None)
    return F.coalesce(record(first_object(html))["author"], F.nullif(meta, F.lit("")), F.nullif(byline, F.lit("")), site)
