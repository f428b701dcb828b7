"""Classification by dictionaries: keywords, categories, rules, methods, embeddings.

A dictionary is an ordered mapping from a name to its keywords; a keyword counts
where it stands anywhere in the lower-case text, inside words too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Dictionary = Mapping[str, Sequence[str]]


def holds(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word.lower()))


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words the text holds."""
    low = F.lower(text)
    return sum((holds(low, w).cast("int") for w in words), F.lit(0))


def any_hit(text: Column, words: Sequence[str]) -> Column:
    return hits(text, words) > 0


def first_category(text: Column, *stages: Dictionary, default: str = "Other") -> Column:
    """The first name, stage by stage and in order, of which the text holds a keyword."""
    out = F.lit(None).cast("string")
    for stage in stages:
        for name, words in stage.items():
            out = F.coalesce(out, F.when(any_hit(text, words), name))
    return F.coalesce(out, F.lit(default))


def categories(text: Column, names: Dictionary, least: int = 2, fallback: Dictionary | None = None, default: str | None = None) -> Column:
    """Names with ``least`` keywords at least; else the fallback's first hit; else the default."""
    found = F.array_compact(F.array(*(F.when(hits(text, w) >= least, n) for n, w in names.items())))
    other = first_category(text, fallback or {}, default=default or "")
    return F.when(F.size(found) > 0, found).when(other != "", F.array(other)).otherwise(found)


def meal_types(text: Column, names: Dictionary, items: Column, minutes: Column) -> Column:
    """Names with a keyword; Snack for 15 minutes or less; Breakfast for egg or bacon; else Dinner or Lunch by size."""
    found = F.array_compact(F.array(*(F.when(any_hit(text, w), n) for n, w in names.items())))
    early = F.exists(items, lambda x: F.lower(x).rlike("egg|bacon"))
    found = F.array_union(found, F.when(minutes <= 15, F.array(F.lit("Snack"))).otherwise(F.array().cast("array<string>")))
    found = F.array_union(found, F.when(early, F.array(F.lit("Breakfast"))).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.when((minutes > 45) | (F.size(items) > 8), "Dinner").otherwise("Lunch")))


def eligible(items: Column, text: Column, rules: Mapping[str, tuple[Sequence[str], Sequence[str]]], most: int = 10) -> Column:
    """Names, in order, whose mention the text has, or of whose forbidden words no item holds one.  Rules: mentions, forbidden."""
    low = F.lower(text)
    parts = F.lower(F.array_join(items, " | "))
    return F.slice(F.array_compact(F.array(*(F.when(any_hit(low, m) | ~any_hit(parts, f), n) for n, (m, f) in rules.items()))), 1, most)


def violations(items: Column, forbidden: Sequence[str]) -> Column:
    return F.filter(items, lambda x: any_hit(x, forbidden))


def primary(steps: Column, methods: Dictionary) -> Column:
    """The method that most steps name, a step counting once; the first of equal ones; null for none."""
    best, most = F.lit(None).cast("string"), F.lit(0)
    for name, words in methods.items():
        n = F.size(F.filter(steps, lambda s: any_hit(s, words)))
        best, most = F.when(n > most, name).otherwise(best), F.greatest(most, n)
    return best


def methods_used(text: Column, methods: Dictionary, default: str = "Mixed") -> Column:
    found = F.array_compact(F.array(*(F.when(any_hit(text, w), n) for n, w in methods.items())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def extracted(text: Column, dictionary: Sequence[str], fallback: str) -> Column:
    """The first word of the dictionary in the text, by whole word (0.95), by part (0.7), else the fallback (0.3)."""
    whole = F.coalesce(*(F.when(F.lower(text).rlike(rf"(?<![a-z0-9_]){w}(?![a-z0-9_])"), w) for w in dictionary))
    part = F.coalesce(*(F.when(holds(F.lower(text), w), w) for w in dictionary))
    value = F.coalesce(whole, part, F.lit(fallback))
    return F.struct(value.alias("value"), F.when(whole.isNotNull(), 0.95).when(part.isNotNull(), 0.7).otherwise(0.3).alias("confidence"))


def structured_steps(steps: Column, actions: Sequence[str]) -> Column:
    """Numbered steps with their first action."""
    return F.transform(steps, lambda s, i: F.struct((i + 1).alias("step_number"), s.alias("text"), F.coalesce(*(F.when(holds(F.lower(s), a), a) for a in actions)).alias("action")))


def atomic_steps(text: Column, actions: Sequence[str]) -> Column:
    """Sentences split at conjunctions; a part without an action goes back to the one before."""
    parts = F.filter(F.transform(F.split(text, r"(?i)[.!?;]+\s*|,?\s+(?:then|and then|and)\s+"), lambda x: F.trim(x)), lambda x: x != "")

    def add(acc: Column, x: Column) -> Column:
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" and "), x)))
        return F.when((F.size(acc) == 0) | any_hit(x, actions), F.concat(acc, F.array(x))).otherwise(joined)

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def ngrams(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rule_embedding(text: Column, vocabulary: Mapping[str, float]) -> Column:
    """Unit vector of weighted counts of the vocabulary's words."""
    low = F.lower(text)
    raw = F.array(*((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) * weight for w, weight in vocabulary.items()))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def bound(value: Column, then) -> Column:
    """``then(value)``, the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def hash_embedding(text: Column, size: int = 768, multiplier: float = 1.0) -> Column:
    """A deterministic unit vector from the rolling hash of the text."""
    from .numbers import rolling_hash

    places = F.sequence(F.lit(0), F.lit(size - 1))

    def unit(raw: Column) -> Column:
        length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
        return bound(length, lambda n: F.transform(raw, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    waves = bound(rolling_hash(text), lambda h: F.transform(places, lambda i: F.sin((h + i * 7919).cast("double")) * multiplier))
    return bound(waves, unit)
