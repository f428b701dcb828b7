"""Item lines and records: names, notes, quantities, times, defaults, search variations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import Record, has
from .text import chain, word

# Words of item lines.
SINGULAR = {"tomatoes": "tomato", "potatoes": "potato", "cherries": "cherry", "berries": "berry", "leaves": "leaf", "halves": "half", "loaves": "loaf", "children": "child", "feet": "foot", "teeth": "tooth", "cloves": "clove", "pieces": "piece", "slices": "slice"}
PREPARATIONS = ("finely minced", "finely diced", "finely chopped", "finely grated", "roughly chopped", "coarsely chopped", "thinly sliced", "thickly sliced", "seeds removed", "cut into chunks", "cut in half", "cut into pieces", "minced", "diced", "chopped", "sliced", "grated", "peeled", "crushed", "ground", "shredded", "julienned", "divided", "torn")
QUALITIES = ("large", "medium", "small", "white", "red", "green", "yellow", "black", "dry", "sweet", "fresh", "frozen", "canned", "organic", "raw", "cooked", "smoked", "salted", "unsalted", "whole", "dried")
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
UNIT_WORDS = r"ounces?|oz\.?|pounds?|lbs?\.?|grams?|g\.?|cups?|tablespoons?|tbsp\.?|teaspoons?|tsp\.?"
NOT_AUTHORS = ("recipe", "course", "ingredient", "equipment", "menu", "navigation", "home", "about", "contact", "blog", "category", "tag", "share", "print", "directions", "steps", "prep", "cook", "time", "servings", "yield", "kitchen", "food", "chef", "editorial", "staff", "team", "magazine", "website", "network", "company", "inc", "llc")
PREP_MINUTES = ((("prep",), 5), (("chop", "dice", "mince"), 3), (("mix", "combine", "stir"), 2), (("wash", "rinse", "clean"), 2), (("peel", "trim"), 3), (("slice", "cut"), 3), (("measure", "weigh"), 1))
COOK_MINUTES = ((("bake", "roast"), 30), (("simmer", "boil"), 15), (("fry", "saute", "sear"), 8), (("grill", "broil"), 10), (("steam",), 12), (("microwave",), 3))
CUISINES = ("Italian", "Chinese", "Mexican", "French", "Indian")
MEALS = ("Breakfast", "Lunch", "Dinner", "Dessert", "Snack")
LABELS = ("Easy", "Quick", "Healthy")
# End of fixed values.


def any_of(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def lemma(c: Column, quantity: Column) -> Column:
    """By the table; by ending only for more than one."""
    low, n = F.lower(c), F.length(c)
    out = F.element_at(F.create_map(*(F.lit(x) for kv in SINGULAR.items() for x in kv)), low)
    cut = lambda k: F.substring(low, F.lit(1), n - k)
    ruled = (
        F.when(F.endswith(low, F.lit("ies")) & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(F.endswith(low, F.lit("ves")) & (n > 4), F.concat(cut(3), F.lit("f")))
        .when(F.endswith(low, F.lit("ses")) & (n > 4), cut(2))
        .when(F.endswith(low, F.lit("s")) & (n > 3) & ~F.endswith(low, F.lit("ss")), cut(1))
    )
    return F.coalesce(out, F.when(quantity > 1, ruled), c)


def core_name(c: Column, quantity: Column, compounds: Sequence[str] = ()) -> Column:
    """The dictionary path: a compound term, else the first word that means something, without amounts and asides."""
    steps = ((r"\([^)]*\)", ""), (",.*$", ""), ("(?i)" + word("if needed|as needed|optional|to taste"), ""), (r"(?i)^\s*(a\s+)?(splash|pinch|dash|hint|touch|bit|drop|drizzle|glug|handful)\s+of\s+", ""), (rf"(?i)^\s*[0-9/\-\s¼-¾⅐-⅞.]+\s*({UNIT_WORDS})(?![A-Za-z0-9_])\s*", ""), (r"^\s*[0-9/\-\s¼-¾⅐-⅞.]+", ""), (r"(?i)^\s*(large|medium|small|whole|half)\s+", ""))
    clean = F.trim(chain(F.coalesce(c, F.lit("")), *steps))
    compound = F.coalesce(*(F.when(F.contains(F.lower(clean), F.lit(x)), x) for x in compounds)) if compounds else F.lit(None).cast("string")
    words = F.filter(F.split(F.lower(clean), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin("the", "and", "or", "of", "in", "on", "at", "to", "for", "with"))
    return F.coalesce(compound, lemma(F.get(words, 0), quantity), F.nullif(clean, F.lit("")), F.lit("unknown ingredient"))


def without_grams(c: Column) -> Column:
    return F.trim(chain(c, (r"(?i)\((?:about\s+|approximately\s+)?[0-9]+(?:\.[0-9]+)?\s*g\)", ""), (r"(?i)\([^)]*;\s*[0-9]+(?:\.[0-9]+)?\s*g\)", ""), (r"(?i)\([0-9]+(?:\.[0-9]+)?\s*ml\)", ""), (r"(?i)\([^)]*;\s*[0-9]+(?:\.[0-9]+)?\s*ml\)", ""), (r"\s+", " ")))


def explicit_grams(c: Column) -> Column:
    """Grams in parentheses, else millilitres."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    found = [F.regexp_extract(c, p, 1).try_cast("double") for p in (rf"(?i)\((?:about\s+|approximately\s+)?{number}\s*g\)", rf"(?i)\([^)]*;\s*{number}\s*g\)", rf"(?i)\({number}\s*ml\)", rf"(?i)\([^)]*;\s*{number}\s*ml\)")]
    return F.coalesce(*found)


def parenthetical_unit(c: Column) -> Column:
    p = rf"(?i)\(([0-9]+(?:\.[0-9]+)?)\s*({UNIT_WORDS})\)"
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).cast("double").alias("quantity"), F.regexp_replace(F.regexp_extract(c, p, 2), r"\.$", "").alias("unit")))


def quantity(c: Column) -> Column:
    """low and high of the first of seven patterns: ranges, mixed numbers, fractions, number words, numbers."""
    d, f = r"([0-9]+(?:\.[0-9]+)?)", r"([0-9]+)/([0-9]+)"
    g = lambda p, n: F.regexp_extract(c, p, n).try_cast("double")
    ratio = lambda p, n: F.try_divide(g(p, n), g(p, n + 1))
    pair = lambda a, b: F.struct(a.cast("double").alias("low"), b.cast("double").alias("high"))
    to_mixed, to, dash, mixed, simple = rf"(?i){d}\s+to\s+{d}\s+{f}", rf"(?i){d}\s+to\s+{d}", rf"{d}\s*-\s*{d}", rf"([0-9]+)\s+{f}", rf"(?<![A-Za-z0-9_]){f}(?![A-Za-z0-9_])"
    named = rf"(?i){word('|'.join(NUMBER_WORDS))}"
    value = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), F.lower(F.regexp_extract(c, named, 0)))
    number = rf"(?<![A-Za-z0-9_]){d}(?![A-Za-z0-9_])"
    return (
        F.when(c.rlike(to_mixed), pair(g(to_mixed, 1), g(to_mixed, 2) + ratio(to_mixed, 3)))
        .when(c.rlike(to), pair(g(to, 1), g(to, 2)))
        .when(c.rlike(dash), pair(g(dash, 1), g(dash, 2)))
        .when(c.rlike(mixed), pair(g(mixed, 1) + ratio(mixed, 2), F.lit(None)))
        .when(c.rlike(simple), pair(ratio(simple, 1), F.lit(None)))
        .when(c.rlike(named), pair(value, F.lit(None)))
        .when(c.rlike(number), pair(g(number, 1), F.lit(None)))
    )


def preparations(c: Column, name: Column) -> Column:
    """Preparations that the text has and the name hasn't; those inside a longer one drop out."""
    low, own = F.lower(c), F.lower(F.coalesce(name, F.lit("")))
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p)) & ~F.contains(own, F.lit(p)), p) for p in PREPARATIONS)))
    return F.filter(found, lambda x: ~F.exists(found, lambda y: F.contains(y, x) & (x != y)))


def notes(c: Column, name: Column) -> Column:
    """Asides of an item line, each once, joined by commas; null for none."""
    low, none = F.lower(c), F.lit(None).cast("string")
    after = F.regexp_extract(without_grams(c), r"^[^,]*,\s*(.+?)(?:\s*\([^)]*\))?$", 1)
    measured = F.regexp_replace(F.regexp_extract(c, r"(?i)\(([^)]*(?:ounce|oz|lb|pound|about|approximately)[^)]*)\)", 1), ";", ",")
    conditional = F.lower(F.regexp_extract(c, "(?i)" + word("if needed|as needed|optional|to taste"), 0))
    brand = F.trim(F.regexp_extract(c, r"(?i),?\s*such as ([^,)]+)", 1))
    own = F.lower(F.coalesce(name, F.lit("")))
    qualities = [F.when(low.rlike(word(q)) & ~own.rlike(word(q)), q) for q in QUALITIES]
    first = F.array_compact(F.array(F.when(F.length(after) > 2, after), F.nullif(measured, F.lit("")), F.nullif(conditional, F.lit("")), F.when(brand != "", F.concat(F.lit("such as "), brand))))
    every = F.array_distinct(F.concat(first, preparations(c, name), F.array_compact(F.array(*qualities))))
    every = F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(every) > 0, F.array_join(every, ", ")).otherwise(none)


def density(name: Column, table: Mapping[str, float]) -> Column:
    """The first entry that holds the name or is held by it; 1 for none."""
    low = F.lower(F.trim(name))
    return F.coalesce(*(F.when((low != "") & (F.contains(low, F.lit(k)) | F.contains(F.lit(k), low)), v) for k, v in table.items()), F.lit(1.0))


def variations(name: Column, synonyms: Mapping[str, Sequence[str]], canonical: Mapping[str, Sequence[str]] | None = None, most: int = 10) -> Column:
    """The name, without descriptors, without "recipe", its group's names, with synonyms put in, and singulars; each once."""
    low = F.lower(F.trim(name))
    bare = F.trim(chain(low, (word("best|perfect|easy|simple|quick|homemade|classic|authentic|traditional|ultimate"), ""), (r"\s+", " ")))
    plain = F.trim(chain(low, (word("recipe|recipes"), "")))
    out = [name, F.when(bare != low, bare), F.when(plain != low, plain)]
    for k, others in (canonical or {}).items():
        hit = low.isin(k.lower(), *(x.lower() for x in others))
        out += [F.when(hit, x) for x in (k, *others)]
    for k, others in synonyms.items():
        out += [F.when(F.contains(low, F.lit(k)), F.regexp_replace(low, f"^(.*?){k}", f"$1{x}")) for x in others]
    out += [F.when(F.endswith(low, F.lit("ies")), F.regexp_replace(low, "ies$", "y")), F.when(F.endswith(low, F.lit("s")) & ~F.endswith(low, F.lit("ss")), F.regexp_replace(low, "s$", ""))]
    return F.slice(F.filter(F.array_distinct(F.array_compact(F.array(*out))), lambda x: F.length(x) > 2), 1, most)


def clean_author(c: Column) -> Column:
    return F.trim(chain(c, (r"\s+", " "), (r"(?i)^\s*by\s+", ""), (r"\s*\|\s*.*$", ""), (r"\s*-\s*.*$", "")))


def valid_author(c: Column) -> Column:
    cleaned = clean_author(F.lower(c))
    return F.coalesce((F.length(c) >= 2) & ~any_of(cleaned, NOT_AUTHORS) & cleaned.rlike("[a-zA-Z]"), F.lit(False))


def site_author(host: Column, sites: Mapping[str, str]) -> Column:
    """The site's author, else its name; "www." doesn't count."""
    bare = F.regexp_replace(host, r"^www\.", "")
    known = F.element_at(F.create_map(*(F.lit(x) for kv in sites.items() for x in kv)), bare) if sites else F.lit(None).cast("string")
    return F.coalesce(known, F.concat(F.split_part(bare, F.lit("."), F.lit(1)), F.lit(" Chef")))


def prep_minutes(steps: Column) -> Column:
    """Minutes by keyword in each step, 10 at least."""
    one = lambda s: sum((F.when(any_of(F.lower(s), w), n).otherwise(0) for w, n in PREP_MINUTES), F.lit(0))
    return F.greatest(F.aggregate(steps, F.lit(0), lambda a, s: a + one(s)), F.lit(10))


def cook_minutes(steps: Column, carried: bool = False) -> Column:
    """Named minutes and hours; steps without any count by keyword (``carried``: only until a step names a time); 5 at least."""
    def one(s: Column) -> tuple[Column, Column]:
        found = F.regexp_extract_all(F.lower(s), F.lit("[0-9]+\\s*(?:minute|min|hour|hr)s?"), F.lit(0))
        named = F.aggregate(found, F.lit(0).cast("long"), lambda a, m: a + F.regexp_extract(m, "[0-9]+", 0).cast("long") * F.when(m.rlike("hour|hr"), 60).otherwise(1))
        guess = F.lit(0)
        for words, n in reversed(COOK_MINUTES):
            guess = F.when(any_of(F.lower(s), words), n).otherwise(guess)
        return F.size(found) > 0, F.when(F.size(found) > 0, named).otherwise(guess.cast("long"))

    start = F.struct(F.lit(0).cast("long").alias("minutes"), F.lit(False).alias("named"))

    def add(acc: Column, s: Column) -> Column:
        named, n = one(s)
        stop = acc["named"] & ~named if carried else F.lit(False)
        return F.struct((acc["minutes"] + F.when(stop, 0).otherwise(n)).alias("minutes"), (acc["named"] | named).alias("named"))

    return F.greatest(F.aggregate(steps, start, add)["minutes"], F.lit(5))


def servings_of(c: Column) -> Column:
    """The first integer, held to 1 to 50; 4 for none."""
    n = F.regexp_extract(c, "[0-9]+", 0).try_cast("int")
    return F.when(n.isNotNull(), F.greatest(F.least(n, F.lit(50)), F.lit(1))).otherwise(4)


def total_minutes(prep: Column, cook: Column, total: Column) -> Column:
    """Zero and negative parts count as 5; a missing total is the sum, or the part that there is."""
    fix = lambda x: F.when(x <= 0, 5).otherwise(x)
    p, c = fix(prep), fix(cook)
    return F.coalesce(fix(total), p + c, p, c)


def defaults(r: Record) -> dict[str, Column]:
    """Lists without blanks; empty ones get a name by the title."""
    low = F.lower(r["title"])

    def filled(name: str, names: Sequence[str], other: str) -> Column:
        kept = F.filter(r[name], lambda x: F.trim(x) != "") if name in r else F.array().cast("array<string>")
        guess = F.coalesce(*(F.when(F.contains(low, F.lit(n.lower())), n) for n in names), F.lit(other))
        return F.when(F.size(kept) > 0, kept).otherwise(F.array(guess))

    return {"cuisines": filled("cuisines", CUISINES, "International"), "meal_types": filled("meal_types", MEALS, "Main Course"), "tags": filled("tags", LABELS, "Homemade")}


def integrity(items: Column, steps: Column, nutrition: Column, metadata: Column, compliance: Column) -> Column:
    """Weighted percentages, rounded."""
    return F.floor(items * 0.25 + steps * 0.25 + nutrition * 0.15 + metadata * 0.15 + compliance * 0.20 + 0.5)


def compliance(fields: Column, known: Sequence[str]) -> Column:
    """100, less 5 for each field that isn't known."""
    extra = F.size(F.array_except(fields, F.array(*map(F.lit, known))))
    return F.greatest(F.lit(0), 100 - extra * 5)


def mentioned(items: Column, text: Column) -> Column:
    """Share of the items that the text names."""
    hit = F.size(F.filter(items, lambda x: F.contains(F.lower(text), F.lower(x))))
    return F.when(F.size(items) > 0, hit / F.size(items)).otherwise(0.0)


def media_completeness(text: Column, items: Column, steps: Column, title: Column) -> Column:
    return F.when(text != "", 0.2).otherwise(0.0) + F.when(F.size(items) > 0, 0.3).otherwise(0.0) + F.when(F.size(steps) > 0, 0.3).otherwise(0.0) + F.when(title != "", 0.2).otherwise(0.0)


def present(r: Record, name: str) -> Column:
    return has(r, name)
