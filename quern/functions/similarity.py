"""Similarity kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of the consonants.
CODED = "BFPVCGJKQSXZDTLMNR"
DIGITS = "111122222222334556"
# End of fixed values.


def similarity(a: Column, b: Column, empty: float = 1.0) -> Column:
    """1 - distance / length of the longer; ``empty`` for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(empty)).otherwise(1 - F.levenshtein(a, b) / longest)


def similarity_from(a: Column, b: Column, least: Column, empty: float = 1.0) -> Column:
    """``similarity`` where it is ``least`` at least; below, that or null.

    Distances are sought within bounds, small ones first, so the work is length times distance and never exceeds what ``least`` allows.
    """
    longest = F.greatest(F.length(a), F.length(b))
    most = F.greatest(F.lit(0), F.least(longest, F.floor((1 - least) * longest) + 1)).cast("int")
    bounds = F.array(*(F.lit(16**i) for i in range(1, 8)))
    within = lambda t: F.call_function("levenshtein", a, b, F.least(t, most))
    distance = F.aggregate(bounds, F.lit(-1), lambda d, t: F.when((d >= 0) | (t / 16 >= F.greatest(most, F.lit(2))), d).otherwise(within(t)))
    return F.when(longest == 0, F.lit(empty)).when(a == b, 1.0).when(distance >= 0, 1 - distance / longest)


def score(a: Column, b: Column) -> Column:
    """Case-blind similarity."""
    return similarity(F.lower(a), F.lower(b))


def phonetic(word: Column) -> Column:
    """First letter and three digits.  Letters without a digit never part two equal digits."""
    up = F.upper(word)
    first = F.substring(up, 1, 1)
    codes = F.translate(F.regexp_replace(up, f"[^{CODED}]", ""), CODED, DIGITS)
    runs = F.regexp_replace(codes, r"(.)\1+", "$1")
    rest = F.when(first.rlike(f"[{CODED}]"), F.substring(runs, 2, 3)).otherwise(F.substring(runs, 1, 3))
    return F.when(F.coalesce(word, F.lit("")) == "", "").otherwise(F.rpad(F.concat(first, rest), 4, "0"))


def sounds_shared(a: Column, b: Column) -> Column:
    """How many of a's words sound like one of b's."""
    words = lambda c: F.split(F.lower(c), " ")
    sounds = F.transform(words(b), lambda w: phonetic(w))
    return F.size(F.filter(words(a), lambda w: F.array_contains(sounds, phonetic(w))))


def boosted(a: Column, b: Column) -> Column:
    """Similarity, and up to 0.2 for words that sound alike."""
    most = F.greatest(F.size(F.split(a, " ")), F.size(F.split(b, " ")))
    return F.least(score(a, b) + sounds_shared(a, b) / most * 0.2, F.lit(1.0))


def close(a: Column, b: Column, threshold: float = 0.7) -> Column:
    s = score(a, b)
    return (s >= threshold) | ((s >= 0.5) & (sounds_shared(a, b) > 0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; lengths must agree."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fit = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    return F.when(fit.isNotNull() | (size == 0), 0.0).otherwise(dot(a, b) / size)
