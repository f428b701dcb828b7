"""Numbers, durations, quantities, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grams a unit, and density by name.
GRAMS = {"gram": 1.0, "kilogram": 1000.0, "ounce": 28.3495, "pound": 453.592, "cup": 240.0, "tablespoon": 15.0, "teaspoon": 5.0, "milliliter": 1.0, "liter": 1000.0}
UNITS = {"cups": "cup", "c": "cup", "tablespoons": "tablespoon", "tbsp": "tablespoon", "teaspoons": "teaspoon", "tsp": "teaspoon", "ounces": "ounce", "oz": "ounce", "pounds": "pound", "lb": "pound", "lbs": "pound", "grams": "gram", "g": "gram", "kg": "kilogram", "ml": "milliliter", "l": "liter"}
# End of fixed values.


def half_up(c: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(c + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def parse_number(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, "[^0-9.-]", ""), r"^-?[0-9]*\.?[0-9]+", 0).try_cast("double")


def human(c: Column) -> Column:
    """Thousands and millions with one decimal, halves up."""
    tenth = lambda unit: F.format_string("%.1f", half_up(c / (unit / 10)) / 10)
    return F.when(c >= 1e6, F.concat(tenth(1e6), F.lit("M"))).when(c >= 1e3, F.concat(tenth(1e3), F.lit("K"))).otherwise(c.cast("string"))


def _ratio(c: Column, pattern: str, num: int) -> Column:
    return F.try_divide(F.regexp_extract(c, pattern, num).try_cast("double"), F.regexp_extract(c, pattern, num + 1).try_cast("double"))


def _leading(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?[0-9]*\.?[0-9]+)", 1).try_cast("double"), F.lit(0.0))


def fraction(c: Column) -> Column:
    """Mixed, simple, then decimal; 0 if none."""
    c = F.trim(c)
    mixed = r"^([0-9]+)\s+([0-9]+)/([0-9]+)$"
    return F.when(c.rlike(mixed), F.regexp_extract(c, mixed, 1).try_cast("double") + _ratio(c, mixed, 2)).when(c.rlike("^[0-9]+/[0-9]+$"), _ratio(c, "^([0-9]+)/([0-9]+)$", 1)).otherwise(_leading(c))


def fraction_simple_first(c: Column) -> Column:
    """A simple fraction anywhere comes first, so "1 1/2" is 0.5."""
    return F.when(c.rlike("[0-9]+/[0-9]+"), _ratio(c, "([0-9]+)/([0-9]+)", 1)).otherwise(_leading(c))


def iso_minutes(c: Column) -> Column:
    """Minutes of an ISO-8601 duration (a year 365 days, a month 30); else the first number."""
    p = r"P(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?T?(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?"
    n = lambda k: F.coalesce(F.regexp_extract(c, p, k).try_cast("double"), F.lit(0.0))
    total = n(1) * 525600 + n(2) * 43200 + n(3) * 1440 + n(4) * 60 + n(5) + half_up(n(6) / 60)
    return F.when(F.startswith(c, F.lit("P")), total.cast("long")).otherwise(F.regexp_extract(c, "[0-9]+", 0).try_cast("long"))


def iso_or_text_minutes(c: Column) -> Column:
    """Weeks too; text such as "2 hours 5 min"; null for nothing."""
    c = F.trim(c)
    p = r"^P(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)W)?(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?$"
    n = lambda k: F.coalesce(F.regexp_extract(c, p, k).try_cast("long"), F.lit(0))
    iso = n(1) * 525600 + n(2) * 43800 + n(3) * 10080 + n(4) * 1440 + n(5) * 60 + n(6)
    part = lambda q: F.coalesce(F.regexp_extract(c, q, 1).try_cast("long"), F.lit(0))
    text = part(r"(?i)([0-9]+)\s*(?:hours?|hr(?![A-Za-z0-9_]))") * 60 + part(r"(?i)([0-9]+)\s*(?:minutes?|min(?![A-Za-z0-9_]))")
    first = F.regexp_extract(c, "^([0-9]+)", 1).try_cast("long")
    return F.when(c.rlike(p), F.when(iso > 0, iso)).when(text > 0, text).when(first > 0, first)


def text_minutes(c: Column) -> Column:
    """Minutes of "2h 30m", "45 min"; null if there is no unit."""
    p = r"(?i)([0-9]+)\s*(?:hours?|hrs?|h)\s*(?:([0-9]+)\s*(?:minutes?|mins?|m))?"
    hours = F.regexp_extract(c, p, 1).try_cast("long") * 60 + F.coalesce(F.regexp_extract(c, p, 2).try_cast("long"), F.lit(0))
    return F.when(c.rlike(p), hours).otherwise(F.regexp_extract(c, r"(?i)([0-9]+)\s*(?:minutes?|mins?|m)", 1).try_cast("long"))


def edge_minutes(c: Column) -> Column:
    """Unanchored PTnHnM, then text, then the first integer."""
    p = r"PT(?:([0-9]+)H)?(?:([0-9]+)M)?"
    iso = F.coalesce(F.regexp_extract(c, p, 1).try_cast("long"), F.lit(0)) * 60 + F.coalesce(F.regexp_extract(c, p, 2).try_cast("long"), F.lit(0))
    return F.coalesce(F.when(c.rlike(p) & (iso > 0), iso), text_minutes(c), F.regexp_extract(c, "[0-9]+", 0).try_cast("long"))


def format_minutes(c: Column) -> Column:
    h, m = F.floor(c / 60), c % 60
    s = lambda x: x.cast("long").cast("string")
    return F.when(c < 60, F.concat(s(c), F.lit("m"))).when(m == 0, F.concat(s(h), F.lit("h"))).otherwise(F.concat(s(h), F.lit("h "), s(m), F.lit("m")))


def timers(c: Column) -> Column:
    """Minutes named in a text: distinct, in order, the first two."""
    mins = F.regexp_extract_all(c, F.lit(r"(?i)([0-9]+)(?:\s*(?:to|-)\s*[0-9]+)?\s*(?:minutes?|mins?)"), F.lit(1))
    ends = F.regexp_extract_all(c, F.lit(r"(?i)[0-9]+\s*(?:to|-)\s*([0-9]+)\s*(?:minutes?|mins?)"), F.lit(1))
    hours = F.regexp_extract_all(c, F.lit(r"(?i)([0-9]+)(?:\.[0-9]+)?\s*(?:hours?|hrs?)"), F.lit(1))
    found = F.concat(F.transform(F.concat(mins, ends), lambda x: x.cast("long")), F.transform(hours, lambda x: x.cast("long") * 60))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, 2)


def temperature(c: Column) -> Column:
    p = r"([0-9]+)\s*°?\s*([CFcf])"
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).try_cast("long").alias("value"), F.upper(F.regexp_extract(c, p, 2)).alias("unit")))


def unit(c: Column) -> Column:
    low = F.replace(F.lower(F.trim(c)), F.lit("."), F.lit(""))
    table = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    return F.coalesce(F.element_at(table, low), low)


def grams(low: Column, high: Column, unit_: Column, density: Column, collapse: str = "first", unknown: float | None = None) -> Column:
    """Grams of a quantity or range in a unit.  ``collapse``: first, max or mean of a range; ``unknown``: grams of another unit."""
    value = {"first": low, "max": F.greatest(low, high), "mean": (low + F.coalesce(high, low)) / 2}[collapse]
    table = F.create_map(*(F.lit(x) for kv in GRAMS.items() for x in kv))
    known = F.element_at(table, unit(unit_))
    volume = unit(unit_).isin("cup", "tablespoon", "teaspoon", "milliliter", "liter")
    return value * F.coalesce(known, F.lit(unknown)) * F.when(volume, density).otherwise(1.0)


def short_md5(c: Column) -> Column:
    return F.substring(F.md5(F.lower(F.trim(c))), 1, 12)


def rolling_hash(c: Column) -> Column:
    """abs of h * 31 + code in 32 bits, over UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("...."), F.lit(0))
    wrap = lambda x: ((x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648
    return F.abs(F.aggregate(units, F.lit(0).cast("long"), lambda h, u: wrap(h * 31 + F.conv(u, 16, 10).cast("long"))))


def rolling_hash_36(c: Column) -> Column:
    return F.lower(F.conv(rolling_hash(c).cast("string"), 10, 36))
