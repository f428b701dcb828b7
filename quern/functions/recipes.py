"""Classifiers and converters over the dictionaries of ``vocabularies``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import classify as C
from . import vocabularies as V
from .numbers import half_up

# Millilitres and grams of units.  Pounds by their short name and kilograms by their long one come out as null.
MILLILITRES = {"cup": 236.5882365, "cups": 236.5882365, "tablespoon": 14.78676478125, "tablespoons": 14.78676478125, "tbsp": 14.78676478125, "teaspoon": 4.92892159375, "teaspoons": 4.92892159375, "tsp": 4.92892159375, "ml": 1.0, "l": 1000.0, "liter": 1000.0, "liters": 1000.0, "pint": 473.176473, "pints": 473.176473, "pt": 473.176473, "quart": 946.352946, "quarts": 946.352946, "qt": 946.352946, "gallon": 3785.411784, "gallons": 3785.411784, "gal": 3785.411784}
WEIGHTS = {"oz": 28.349523125, "ounce": 28.349523125, "ounces": 28.349523125, "g": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "pound": 453.59237, "pounds": 453.59237}
# Names of diets, in the order in which they are found.
SUITABLE = ("Gluten-Free", "Dairy-Free", "Lactose-Intolerant", "Nut-Free", "Peanut-Free", "Soy-Free", "Egg-Free", "Shellfish-Free", "Fish-Free", "Vegetarian", "Vegan", "Pescatarian", "Ketogenic", "Low Carb", "Low Sodium", "Kosher", "Halal", "Paleo", "Sugar-Free", "Heart-Healthy")
DESCRIPTORS = "organic|fresh|dried|frozen|canned|chopped|minced|sliced"
# End of fixed values.


def table(values: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def category(name: Column) -> Column:
    """Priority names, then the categories' words, then patterns, else Other."""
    return C.first_category(name, V.PRIORITY, V.CATEGORIES, V.PATTERNS)


def cuisines(text: Column) -> Column:
    """Those with two words or more; else one by a broad rule; else International."""
    low = F.lower(text)
    has = lambda w: C.holds(low, w)
    found = F.array_compact(F.array(*(F.when(C.hits(text, words) >= 2, name) for name, words in V.CUISINES.items())))
    broad = F.when(has("pasta") | has("pizza"), "Italian").when(has("rice") & (has("soy") | has("ginger")), "Asian").when(has("olive oil") & has("herbs"), "Mediterranean").otherwise("International")
    return F.when(F.size(found) > 0, found).otherwise(F.array(broad))


def named(text: Column, family: Mapping[str, Sequence[str]]) -> Column:
    return F.array_compact(F.array(*(F.when(C.any_hit(text, words), name) for name, words in family.items())))


def tags(text: Column, items: Column, effort: Column, minutes: Column, found: Column, meals: Column) -> Column:
    """Methods, a level, occasions, styles and seasons that the text names, first words of three items, cuisines and meals; each once."""
    level = F.when((effort <= 2) & (minutes <= 30), "Easy").when((effort >= 4) | (minutes > 120), "Advanced").otherwise("Intermediate")
    first = F.filter(F.transform(F.slice(items, 1, 3), lambda x: F.split_part(x, F.lit(" "), F.lit(1))), lambda w: F.length(w) > 3)
    first = F.transform(first, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    families = [named(text, V.TAGS[k]) for k in ("Occasion", "Dietary", "Season")]
    return F.array_distinct(F.concat(named(text, V.TAGS["Cooking Methods"]), F.array(level), *families, first, F.filter(found, lambda c: c != "International"), meals))


def cooking_method(steps: Column, equipped: Column | None = None) -> Column:
    """The method of most weight.

    A word in a step counts by the method's weight, more the later the step, twice in steps with times or degrees, half
    as much again in steps with equipment (``equipped``: flags) and 2.5 times for heat.  Of equal methods the one met
    first wins.  A method without heat gives way to the best one with heat that has over three tenths of its score.
    """
    n = F.size(steps)
    kit = equipped if equipped is not None else F.transform(steps, lambda s: F.lit(False))
    weight = F.transform(steps, lambda s, i: (1 + i / n * 2) * F.when(F.lower(s).rlike("minutes|hours|°|degrees"), 2.0).otherwise(1.0) * F.when(F.get(kit, i), 1.5).otherwise(1.0))

    def scored(k: int, name: str, words: Sequence[str]) -> Column:
        factor = V.METHOD_WEIGHTS.get(name, 5) * (2.5 if name in V.HEAT else 1.0)
        ones = F.transform(steps, lambda s, i: F.get(weight, i) * C.hits(s, words))
        score = F.round(F.aggregate(ones, F.lit(0.0), lambda a, x: a + x) * factor, 6)
        first = F.array_position(F.transform(steps, lambda s: C.any_hit(s, words)), F.lit(True))
        return F.when(score > 0, F.struct(score.alias("score"), (-first).alias("first"), F.lit(-k).alias("ord"), F.lit(V.METHOD_NAMES[name]).alias("name"), F.lit(name in V.HEAT).alias("heat")))

    found = F.array_compact(F.array(*(scored(k, name, words) for k, (name, words) in enumerate(V.METHODS.items()))))
    top, hot = F.array_max(found), F.array_max(F.filter(found, lambda x: x["heat"]))
    better = ~top["heat"] & hot.isNotNull() & (hot["score"] > 0.3 * top["score"])
    return F.when(n == 0, "No Method").when(F.size(found) == 0, "Mixed").when(better, hot["name"]).otherwise(top["name"])


def methods(steps: Column) -> Column:
    """Names of all methods, in the order in which the steps meet them."""
    each = F.transform(steps, lambda s: F.array_compact(F.array(*(F.when(C.any_hit(s, words), V.METHOD_NAMES[name]) for name, words in V.METHODS.items()))))
    return F.array_distinct(F.flatten(each))


def either_way(names: Column, words: Sequence[str]) -> Column:
    """Whether a name holds a word or is part of one."""
    return F.exists(names, lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w) | F.contains(w, x)))


def clean_names(items: Column) -> Column:
    low = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[®™©]", ""), rf"(?<![a-z0-9_])({DESCRIPTORS})(?![a-z0-9_])", ""))
    return F.filter(F.transform(low, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def suitable(items: Column, carbs: Column | None = None, fat: Column | None = None, sodium: Column | None = None) -> Column:
    """Diets that the items allow; with nutrients, those that go by them, too.  None without items."""
    names = clean_names(items)
    has = lambda words: either_way(names, words)
    meat, sea, dairy, egg = has(V.MEAT), has(V.SEAFOOD), has(V.DAIRY), has(V.EGG)
    holds = lambda words: F.exists(names, lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w)))
    no, salty, heavy = F.lit(False), has(V.HIGH_SODIUM), has(V.HIGH_CARB)
    known = carbs is not None
    rules = {
        "Gluten-Free": ~has(V.GLUTEN), "Dairy-Free": ~dairy, "Lactose-Intolerant": ~dairy, "Nut-Free": ~has(V.NUT), "Peanut-Free": ~has(V.PEANUT), "Soy-Free": ~has(V.SOY), "Egg-Free": ~egg,
        "Shellfish-Free": ~has(V.SHELLFISH), "Fish-Free": ~sea, "Vegetarian": ~meat & ~sea, "Vegan": ~meat & ~sea & ~dairy & ~egg & ~holds(V.ANIMAL), "Pescatarian": ~meat & sea,
        "Ketogenic": (carbs < 10) & (fat >= 15) & ~heavy if known else no, "Low Carb": (carbs < 20) & ~heavy if known else no, "Low Sodium": ~salty | (sodium < 0.14) if known else ~salty,
        "Kosher": ~has(V.NOT_KOSHER) & ~(meat & dairy), "Halal": ~has(V.NOT_HALAL), "Paleo": ~has(V.NOT_PALEO), "Sugar-Free": ~has(V.SUGAR), "Heart-Healthy": holds(V.WHOLESOME) & ~salty & ~holds(V.UNWHOLESOME),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(rules[name], no), name) for name in SUITABLE)))
    return F.when(F.size(items) > 0, found).otherwise(F.array().cast("array<string>"))


def validated(found: Column) -> Column:
    """Without what a stricter diet implies."""
    implied = F.array_compact(F.array(F.when(F.array_contains(found, "Vegan"), "Vegetarian"), F.when(F.array_contains(found, "Ketogenic"), "Low Carb")))
    return F.array_except(found, implied)


def grams(quantity: Column, unit: Column, density: Column) -> Column:
    """Pieces by their table, volumes by density, weights as they are, to two decimals; null for other units."""
    low = F.lower(unit)
    other = F.coalesce(F.element_at(table(MILLILITRES), low) * density, F.element_at(table(WEIGHTS), low))
    return F.coalesce(quantity * F.element_at(table({k: float(v) for k, v in V.PIECES.items()}), low), half_up(quantity * other * 100) / 100)


def grams_by_item(quantity: Column, unit: Column, item: Column) -> Column:
    """The item's own table first, then the units', else a fixed amount of grams."""
    own = table({f"{i} {u}": g for i, units in V.ITEM_GRAMS.items() for u, g in units.items()})
    return quantity * F.coalesce(F.element_at(own, F.concat(item, F.lit(" "), unit)), F.element_at(table(V.UNIT_GRAMS), unit), F.lit(V.UNKNOWN_GRAMS))


def simple_grams(quantity: Column, unit: Column) -> Column:
    """Whole grams by the simple table, whatever the item; null for other units and for no quantity."""
    return half_up(F.when(quantity != 0, quantity) * F.element_at(table(V.SIMPLE_GRAMS), F.lower(unit)))
