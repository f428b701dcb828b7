"""Text expressions: cleaning, keys, extraction.  All are built from Spark's own functions.

White space includes the no-break space and the byte-order mark; word boundaries
are those of ASCII words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s ﻿]"
# Replacements of typographic characters.
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6"}
SUPERSCRIPTS = {"¹": "1", "²": "2", "³": "3", "⁴": "4", "⁵": "5", "⁶": "6", "⁷": "7", "⁸": "8", "⁹": "9", "⁰": "0"}
SYMBOLS = "®™©℠°∞‰§…•◦▪▫\"'–—₁₂₃₄₅₆₇₈₉₀"
MARKS = "®™©℠"
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&deg;": "°", "&frac14;": "¼", "&frac12;": "½", "&frac34;": "¾"}
ABBREVIATIONS = {"lbs.": "pounds", "lb.": "pound", "oz.": "ounce", "tbsp.": "tablespoon", "tsp.": "teaspoon", "qt.": "quart", "pt.": "pint", "approx.": "approximately", "mins.": "minutes", "min.": "minute", "hrs.": "hours", "hr.": "hour", "temp.": "temperature", "thru": "through", "til": "until"}
IRREGULAR = {"leaf": "leaves", "knife": "knives", "child": "children"}
LENGTHS = {"title": 200, "description": 500, "ingredients": 1000, "instructions": 1500}
ARTICLES, NOUNS = "the|a|an", "recipe|recipes"
TITLE_WORDS = "best|perfect|easy|simple|ultimate|classic"
NAME_WORDS = "best|perfect|easy|simple|quick|homemade|classic|authentic|traditional"
ITEM_UNITS = "cup|cups|tablespoon|tablespoons|teaspoon|teaspoons|pound|pounds|ounce|ounces|gram|grams|kg|lb|oz|tsp|tbsp"
ITEM_WORDS = "fresh|dried|chopped|minced|diced|sliced|whole|ground"
SHORT_ITEMS = "(?i)^(oz|lb|ml|qt|pt|tsp|cup|bay)$"
NOT_ITEMS = (
    "^[A-Z]{1,3}$", "^[a-z]{1,2}$", "^[0-9]+$", r"^[\s\-.,;:]+$", r"^[()\[\]{}]+$", "(?i)^(and|or|with|plus|also|see|note|tips?|add|use)$",
    "(?i)^(step|method|recipe|cooking|preparation|instructions?)$", "(?i)^(serves?|servings?|yield|makes?)$", "(?i)^(minutes?|hours?|mins?|hrs?|time|cook|prep)$",
    "(?i)^(degrees?|°|f|c|fahrenheit|celsius)$", "(?i)^(page|pages?|recipe|ingredients?)$", "(?i)^(kitchen|equipment|tools?)$", "^[*#@%&]+$",
    r"(?i)^(www|http|https|com|org|net)\.?", "(?i)^(copyright|©|®|™|all|rights|reserved)$",
)
ITEM_LINES = ("^[0-9]+", "^[•*-]", r"(?i)[0-9]+\s*(cup|tbsp|tsp|oz|lb|g|kg|ml|l|teaspoon|tablespoon|pound|ounce|gram)", r"(?i)^(a|an|the)\s+[A-Za-z0-9_]+")
STEP_LINES = (r"^[0-9]+[.)]\s*", "(?i)^(first|second|third|then|next|finally)", "^[•*-]", "(?i)^(heat|cook|bake|mix|stir|add|pour|place|cut|chop|slice|dice|sauté|fry)")
HEADER_LINE = r"(?i)^(ingredients?|instructions?|directions?|method|steps?):?\s*$"
SERVINGS = (r"(?i)(?:serves?|serving|servings?|makes?|yield|feeds?)[\s:]*([0-9]+)", r"(?i)([0-9]+)\s*(?:servings?|portions?|people)")
# End of fixed values.


def word(pattern: str) -> str:
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def trim(c: Column) -> Column:
    return replace(c, f"^{SPACE}+|{SPACE}+$")


def collapse(c: Column) -> Column:
    return replace(c, f"{SPACE}+", " ")


def swap(c: Column, table: dict[str, str]) -> Column:
    for a, b in table.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def without(c: Column, letters: str) -> Column:
    return F.translate(c, letters, "")


def clean_ingredient(c: Column) -> Column:
    """Fractions and superscripts to ASCII, symbols and the word "brand" out, no comma or dash at the end."""
    c = without(swap(swap(F.coalesce(c, F.lit("")), FRACTIONS), SUPERSCRIPTS), SYMBOLS)
    return chain(trim(collapse(replace(c, "(?i)" + word("brand")))), (r"\s*,\s*$", ""), (r"\s*-\s*$", ""))


def clean_title(c: Column) -> Column:
    return trim(collapse(F.translate(without(swap(F.coalesce(c, F.lit("")), FRACTIONS), MARKS), "–—", "--")))


clean_description = clean_title


def clean_instruction(c: Column) -> Column:
    """Like a title, with superscripts to digits; degree signs stay."""
    return clean_title(swap(F.coalesce(c, F.lit("")), SUPERSCRIPTS))


def decode_entities(c: Column) -> Column:
    """Named entities in their fixed order (so a double-encoded one is decoded twice), then numeric ones."""
    for name, by in ENTITIES.items():
        c = replace(c, "(?i)" + name, by.replace("\\", "\\\\").replace("$", "\\$"))

    def numeric(text: Column, pattern: str, code) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        return F.aggregate(found, text, lambda acc, m: F.replace(acc, m, F.decode(F.unhex(F.lpad(F.hex(code(m)), 4, "0")), "UTF-16BE")))

    digits = lambda m: F.regexp_replace(m, "[^0-9A-Fa-f]", "")
    c = numeric(c, "&#[0-9]{1,5};", lambda m: F.least(digits(m).cast("long"), F.lit(65533)))
    return numeric(c, "(?i)&#x[0-9a-f]{1,4};", lambda m: F.conv(digits(m), 16, 10).cast("long"))


def sanitize(c: Column, kind: str = "ingredient") -> Column:
    return {"ingredient": clean_ingredient, "title": clean_title, "instruction": clean_instruction, "description": clean_description}[kind](decode_entities(c))


def normalize(c: Column) -> Column:
    return F.lower(collapse(trim(c)))


def capitalize_words(c: Column) -> Column:
    """The first ASCII letter of each ASCII word in upper case, the rest untouched."""
    parts = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def strip_tags(c: Column) -> Column:
    return trim(replace(c, "<[^>]*>"))


def numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]+\.?[0-9]*"), F.lit(0)), lambda x: x.cast("double"))


def fractions(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"[0-9]+/[0-9]+"), F.lit(0))
    return F.transform(found, lambda x: F.try_divide(F.split_part(x, F.lit("/"), F.lit(1)).cast("double"), F.split_part(x, F.lit("/"), F.lit(2)).cast("double")))


def pluralize(c: Column, count: Column) -> Column:
    out = F.when(count == 1, c)
    for a, b in IRREGULAR.items():
        out = out.when(c == a, b)
    return out.when(c.rlike("(s|sh|ch)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))


def title_key(c: Column) -> Column:
    """The order of the steps matters: spaces left by removed words stay, and one at the end keeps an s."""
    return F.trim(chain(trim(F.lower(c)), (r"[^A-Za-z0-9_\s-]", ""), (r"\s+", " "), (word(ARTICLES), ""), (word(NOUNS), ""), (word(TITLE_WORDS), ""), ("ies$", "y"), ("s$", "")))


def ingredient_key(c: Column) -> Column:
    return F.trim(chain(trim(F.lower(c)), (r"[^A-Za-z0-9_\s]", ""), ("[0-9]+", ""), (r"\s+", " "), (word(ITEM_UNITS), ""), (word(ITEM_WORDS), "")))


def name_key(c: Column) -> Column:
    return F.trim(chain(trim(F.lower(c)), (word(NAME_WORDS), ""), (word(NOUNS), ""), (r"[^a-z0-9\s-]", ""), (r"\s+", " ")))


def source_key(c: Column) -> Column:
    return chain(trim(F.lower(c)), (r"[^A-Za-z0-9_\s-]", ""), (r"\s+", " "), ("ies$", "y"), ("s$", ""))


def expand(c: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    """Longest abbreviations first; a boundary stands on both sides, so one that ends in a dot needs a word after it."""
    for a in sorted(table, key=lambda x: (-len(x), x)):
        quoted = a.replace(".", r"\.")
        after = "(?![A-Za-z0-9_])" if a[-1].isalnum() else "(?=[A-Za-z0-9_])"
        c = replace(c, rf"(?i)(?<![A-Za-z0-9_]){quoted}{after}", table[a])
    return c


def normalize_instruction(c: Column) -> Column:
    steps = [(r"\s*,\s*", ", "), (r"\s*\.\s*", ". "), (r"\s*;\s*", "; "), (r"\s*:\s*", ": "), (r"([0-9]+)\s*°\s*([CF])(?![A-Za-z0-9_])", "$1°$2"), (r"(?i)([0-9]+)\s*degrees?\s*([CF])(?![A-Za-z0-9_])", "$1°$2"), ("1/2", "½"), ("1/3", "⅓"), ("1/4", "¼"), ("3/4", "¾"), ("2/3", "⅔"), (r"([0-9]+)\s*-\s*([0-9]+)", "$1-$2"), (r"\s+", " ")]
    return F.trim(chain(expand(c), *steps))


def dedup_words(c: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(F.lower(trim(c)), r"\s+")), " ")


def hashtags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("#([A-Za-z0-9_]+)"), F.lit(1))


def truncate(c: Column, kind: str) -> Column:
    """Cut at the kind's length, then at the last space if that is in the last fifth."""
    n = LENGTHS.get(kind, 500)
    c = F.trim(chain(c, (r"[^A-Za-z0-9_\s.,!?-]", " "), (r"\s+", " ")))
    short = F.trim(F.substring(c, 1, n))
    last = F.length(short) - F.instr(F.reverse(short), " ")
    cut = F.when((F.instr(short, " ") > 0) & (last > 0.8 * n), F.substring(short, F.lit(1), last)).otherwise(short)
    return F.when(F.length(c) > n, cut).otherwise(c)


def bundle(title: Column, description: Column, items: Column, tags: Column) -> Column:
    """The labelled parts that aren't empty, of the items the first seven up to their commas."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    first = F.transform(F.slice(items, 1, 7), lambda x: F.split_part(x, F.lit(","), F.lit(1)))
    return F.concat_ws(". ", F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), part("Desc", F.substring(description, 1, 150)), part("Ingredients", F.array_join(first, ", ")), part("Tags", F.array_join(tags, ", ")))


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def distinct_lines(c: Column) -> Column:
    return F.array_distinct(lines(c))


def sentences_with(c: Column, words: Sequence[str]) -> Column:
    """Sentences that hold any of the words, joined by a full stop and a space."""
    hit = lambda s: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(s), w))
    return F.array_join(F.filter(F.transform(F.split(c, "[.!?]+"), lambda x: F.trim(x)), lambda s: (s != "") & hit(s)), ". ")


def step_list(c: Column) -> Column:
    """Headings out, bullets and numbers stripped; numbered before the empty ones go, so numbers can have gaps."""
    kept = F.filter(F.split(c, "\r?\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
    clean = F.transform(kept, lambda x, i: F.struct((i + 1).alias("step_number"), F.trim(F.regexp_replace(F.trim(x), r"^([-*•]|[0-9]+[.)])\s*", "")).alias("text")))
    return F.filter(clean, lambda s: s["text"] != "")


def servings(c: Column) -> Column:
    """The first count between 1 and 99 that a pattern finds."""
    def one(pattern: str) -> Column:
        n = F.regexp_extract(c, pattern, 1).try_cast("int")
        return F.when(n.between(1, 99), n)

    return F.coalesce(*map(one, SERVINGS))


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def valid_line(c: Column) -> Column:
    """Whether a line can name an item: long enough, none of the fixed non-items, half of it letters and digits."""
    t = F.trim(c)
    bad = matches_any(t, NOT_ITEMS)
    distinct = F.size(F.array_distinct(F.split(F.regexp_replace(F.lower(t), r"\s", ""), "")))
    short = (F.length(t) <= 2) & ~t.rlike(SHORT_ITEMS)
    letters = F.length(F.regexp_replace(t, "[^a-zA-Z0-9]", ""))
    return F.coalesce((t != "") & ~short & ~bad & t.rlike("[a-zA-Z]") & (letters / F.length(t) >= 0.5) & ~((F.length(t) > 3) & (distinct <= 2)), F.lit(False))


def item_line(c: Column) -> Column:
    return F.length(c).between(3, 200) & matches_any(c, ITEM_LINES)


def step_line(c: Column) -> Column:
    return F.length(c).between(10, 500) & matches_any(c, STEP_LINES)


def header_line(c: Column) -> Column:
    return c.rlike(HEADER_LINE) | (F.length(c) < 5)


def relevance(c: Column, words: Sequence[str]) -> Column:
    """Share of the vocabulary that the text holds."""
    low = F.lower(c)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) / F.lit(len(words))
