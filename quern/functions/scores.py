"""Rule scores of a record.

A record is a mapping of field names to columns: title, description, author,
image_url, source_url (strings); items, steps, tags, cuisines, meal_types, diets,
methods (arrays of strings); prep, cook, total, servings, effort, calories
(numbers).  A field that is missing from the mapping counts as empty.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import bound

Record = Mapping[str, Column]
LISTS = {"items", "steps", "tags", "cuisines", "meal_types", "diets", "methods"}
NUMBERS = {"prep", "cook", "total", "servings", "effort", "calories"}


def has(r: Record, name: str) -> Column:
    if name not in r:
        return F.lit(False)
    c = r[name]
    found = F.size(c) > 0 if name in LISTS else c != 0 if name in NUMBERS else c != ""
    return F.coalesce(found, F.lit(False))


def size(r: Record, name: str) -> Column:
    return F.coalesce(F.greatest(F.size(r[name]), F.lit(0)), F.lit(0)) if name in r else F.lit(0)


def points(*rules: tuple[Column, float]) -> Column:
    out = F.lit(0)
    for condition, n in rules:
        out = out + F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)
    return out


def percent(part: Column, of: float) -> Column:
    return F.floor(part / of * 100 + 0.5)


def completeness_a(r: Record) -> Column:
    return F.least(points(
        (F.length(r["title"]) > 5, 15), (F.length(r["description"]) > 20, 10), (size(r, "items") >= 3, 20),
        ((size(r, "items") >= 3) & F.exists(r["items"], lambda x: x.rlike("[0-9]")) & F.exists(r["items"], lambda x: x.rlike("(?i)cup|gram|ounce")), 5),
        (size(r, "steps") >= 2, 20), ((size(r, "steps") >= 2) & F.exists(r["steps"], lambda x: x.rlike("(?i)bake|mix|stir")), 5), (has(r, "calories"), 10),
        (has(r, "prep") | has(r, "cook"), 5), (has(r, "total"), 5), (has(r, "servings"), 2), (has(r, "cuisines"), 1), (has(r, "meal_types"), 1), (has(r, "tags"), 1),
    ), F.lit(100))


def completeness_b(r: Record) -> Column:
    tens, fives = ("title", "description", "items", "steps", "prep", "cook", "image_url"), ("servings", "effort", "cuisines", "author", "diets", "tags")
    return F.least(points(*((has(r, x), 10) for x in tens), *((has(r, x), 5) for x in fives)), F.lit(100))


def completeness_c(r: Record) -> Column:
    return F.least(points(
        (has(r, "title"), 10), (has(r, "items"), 25), (has(r, "steps"), 25), (has(r, "image_url"), 5), (has(r, "servings"), 5),
        (has(r, "prep") | has(r, "cook") | has(r, "total"), 5), (has(r, "description"), 5), (has(r, "calories"), 10), (has(r, "tags"), 5), (has(r, "cuisines"), 5),
    ), F.lit(100))


FIELDS_D = ("title", "description", "items", "steps", "prep", "cook", "servings", "cuisines", "effort", "diets", "tags", "author", "image_url", "source_url")


def completeness_d(r: Record) -> Column:
    return percent(points(*((has(r, x), 1) for x in FIELDS_D), (size(r, "items") >= 3, 1)), 15)


def completeness_e(r: Record) -> Column:
    plain = ("title", "description", "prep", "cook", "servings", "cuisines", "tags", "image_url", "author", "calories", "methods", "meal_types", "effort")
    return percent(points(*((has(r, x), 1) for x in plain), (size(r, "items") >= 3, 1), (size(r, "steps") >= 2, 1)), 15)


def completeness_f(r: Record) -> Column:
    five, three = ("title", "items", "steps", "source_url"), ("description", "author", "prep", "cook", "servings", "image_url")
    one = ("cuisines", "meal_types", "tags", "calories", "methods", "diets")
    return percent(points(*((has(r, x), 5) for x in five), *((has(r, x), 3) for x in three), *((has(r, x), 1) for x in one)), 44)


def completeness_g(r: Record) -> Column:
    two = ("title", "source_url", "items", "steps", "author", "prep", "cook", "total", "servings")
    one = ("description", "image_url", "cuisines", "meal_types", "tags", "methods", "diets", "calories", "effort")
    return percent(points(*((has(r, x), 2) for x in two), *((has(r, x), 1) for x in one)), 27)


def completeness_governance(r: Record) -> Column:
    return points(*((has(r, x), 1) for x in ("title", "items", "steps", "prep", "servings"))) / 5


def completeness_media(r: Record) -> Column:
    base, bonus = ("title", "description", "items", "steps"), ("image_url", "author", "tags")
    return F.least(points(*((has(r, x), 17.5) for x in base), *((has(r, x), 10.0) for x in bonus)), F.lit(100.0))


def mean_length(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x)) / F.size(c)


def confidence_presence(r: Record) -> Column:
    named = F.exists(r["items"], lambda x: x != "")
    acted = F.exists(r["steps"], lambda x: x.rlike("(?i)bake|mix|stir"))
    return F.least(points((has(r, "title"), 20), (has(r, "items"), 30), (has(r, "steps"), 30), (named, 10), (acted, 10)), F.lit(100))


def confidence_means(r: Record) -> Column:
    return F.least(F.lit(50) + points(
        (has(r, "items") & (mean_length(r["items"]) > 3), 15), (has(r, "steps") & (mean_length(r["steps"]) > 20), 15), (has(r, "servings") & has(r, "prep"), 10),
        (has(r, "cuisines"), 5), (has(r, "effort") & (r["effort"] != 3), 5) if "effort" in r else (F.lit(False), 5),
    ), F.lit(100))


def confidence_counts(r: Record, base: int = 70, item: int = 2, step: int = 3) -> Column:
    return F.least(F.lit(95), base + size(r, "items") * item + size(r, "steps") * step)


# What marks good and poor content.
MEASURED = (r"[0-9]+\s*(cup|tablespoon|teaspoon|pound|ounce|gram|kilogram|ml|liter)", r"[0-9]+/[0-9]+", r"[0-9]+\s*-\s*[0-9]+")
ACTED = (r"(?<![a-z0-9_])(preheat|heat|cook|bake|sauté|simmer|boil|mix|stir|add|remove)(?![a-z0-9_])", r"[0-9]+\s*(minute|hour|second)", "[0-9]+°[cf]")
POOR = ("lorem ipsum", "placeholder", r"\[.*\]", "xxx+", "test")
SPAM = ("buy now", "click here", "special offer", "limited time", "(viagra|casino|poker|lottery)")
RESTRICTED = ("proprietary", "signature.*recipe", "chef.*special", "restaurant.*secret")
SENSITIVE = ("personal.*information", "contact.*details", "payment.*info", "subscription.*data")
# End of fixed values.


def matches(c: Column, patterns) -> Column:
    return F.lower(c).rlike("|".join(patterns))


def item_quality(items: Column) -> Column:
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + F.when(matches(x, MEASURED), 1.0).otherwise(0.0) + F.when(F.length(F.trim(x)) > 3, 0.5).otherwise(0.0))
    return F.when(F.size(items) > 0, total / (F.size(items) * 1.5)).otherwise(0.0)


def step_quality(steps: Column) -> Column:
    timed = r"[0-9]+\s*(minute|hour|°[cf])"
    one = lambda x: F.when(matches(x, ACTED), 1.0).otherwise(0.0) + F.when(F.length(F.trim(x)) > 10, 0.5).otherwise(0.0) + F.when(F.lower(x).rlike(timed), 0.3).otherwise(0.0)
    total = F.aggregate(steps, F.lit(0.0), lambda a, x: a + one(x))
    return F.when(F.size(steps) > 0, total / (F.size(steps) * 1.8)).otherwise(0.0)


def content_issues(r: Record) -> Column:
    every = F.concat_ws(" ", r["title"], r["description"], F.array_join(r["items"], " "), F.array_join(r["steps"], " "))
    return F.array_compact(F.array(
        F.when(matches(every, SPAM), "spam"), F.when(matches(every, POOR), "placeholder"), F.when(item_quality(r["items"]) < 0.5, "items"),
        F.when(step_quality(r["steps"]) < 0.5, "steps"), F.when((r["title"] != "") & (F.length(r["title"]) < 10), "title"),
    ))


def content_score(issues: Column) -> Column:
    cost = {"spam": 0.5, "placeholder": 0.3, "items": 0.2, "steps": 0.2, "title": 0.1}
    lost = lambda found: sum((F.when(F.array_contains(found, k), v).otherwise(0.0) for k, v in cost.items()), F.lit(0.0))
    return bound(issues, lambda found: F.greatest(F.lit(0.0), 1.0 - lost(found)))


def consistency_issues(r: Record) -> Column:
    three = has(r, "prep") & has(r, "cook") & has(r, "total")
    planned = r["prep"] + r["cook"]
    return F.array_compact(F.array(
        F.when(three & (F.abs(planned - r["total"]) > planned * 0.2), "times"), F.when(r["servings"] > 50, "servings"),
        F.when(has(r, "servings") & (size(r, "items") < 2) & (r["servings"] > 10), "items"), F.when(r["calories"] > 5000, "calories"),
    ))


def times_far_apart(r: Record) -> Column:
    """The validator's variant: more than 15 minutes."""
    return has(r, "prep") & has(r, "cook") & has(r, "total") & (F.abs(r["prep"] + r["cook"] - r["total"]) > 15)


def quality(r: Record, schema_ok: Column) -> Column:
    flags = (F.length(F.trim(r["title"])) > 0, size(r, "items") >= 2, size(r, "steps") >= 1, has(r, "prep") | has(r, "cook") | has(r, "total"), has(r, "servings"), has(r, "calories"))
    complete = points(*((f, 1) for f in flags)) / 6
    score = F.when(schema_ok, 0.25).otherwise(0.0) + complete * 0.35 + content_score(content_issues(r)) * 0.30 + F.when(F.size(consistency_issues(r)) == 0, 0.10).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def classification(c: Column) -> Column:
    return F.when(matches(c, SENSITIVE), "sensitive").when(matches(c, RESTRICTED), "restricted").otherwise("public")


def personal(c: Column) -> Column:
    return matches(c, ("email", "phone", "address"))


def check_bounds(c: Record, bounds: Mapping[str, tuple[float, float]]) -> Column:
    """Issues of a schema: path and message for each field out of its bounds (length of strings and lists, value of numbers)."""
    def measure(name: str) -> Column:
        return c[name] if name in NUMBERS else F.size(c[name]) if name in LISTS else F.length(c[name])

    out = []
    for name, (low, high) in bounds.items():
        m = measure(name)
        out += [F.when(m < low, f"{name}: below {low}"), F.when(m > high, f"{name}: above {high}")]
    return F.array_compact(F.array(*out))


def fixed(r: Record) -> dict[str, Column]:
    """Defaults and caps: servings 1 to 50 (4 if missing), times under 1440, total from the parts; the audit names what was changed."""
    servings = F.when(has(r, "servings"), F.greatest(F.lit(1), F.least(F.lit(50), r["servings"]))).otherwise(4)
    cap = lambda c: F.least(c, F.lit(1440))
    prep = F.when(has(r, "prep"), cap(r["prep"])).otherwise(F.greatest(F.lit(10), size(r, "items") * 2))
    cook = F.when(has(r, "cook"), cap(r["cook"])).otherwise(F.lit(15))
    total = F.when(has(r, "total"), cap(r["total"])).otherwise(prep + cook)
    new = {"servings": servings, "prep": prep, "cook": cook, "total": total}
    audit = F.array_compact(F.array(*(F.when(~r[k].eqNullSafe(v), k) for k, v in new.items())))
    return new | {"changed": audit}


def health_continuous(n: Record) -> Column:
    """Nutrients: protein, fiber, saturated, sodium, sugar, fat, carbs, calories; null if there are none."""
    v = {k: F.coalesce(c, F.lit(0.0)) for k, c in n.items()}
    score = 50 + F.least(v["protein"], F.lit(30.0)) + F.least(v["fiber"] * 2, F.lit(20.0)) - F.least(v["saturated"] * 2, F.lit(20.0))
    score = score - F.when(v["sodium"] > 200, F.least((v["sodium"] - 200) / 50, F.lit(20.0))).otherwise(0.0) - F.when(v["sugar"] > 10, F.least((v["sugar"] - 10) * 2, F.lit(20.0))).otherwise(0.0)
    none = (v["calories"] == 0) & (v["fat"] == 0) & (v["carbs"] == 0) & (v["protein"] == 0)
    return F.when(~none, F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + 0.5))))


def health_steps(n: Record) -> Column:
    p = points((n["protein"] > 10, 15), (n["fiber"] > 5, 15), ((n["calories"] < 400) & (n["calories"] > 0), 10), (n["saturated"] > 5, -10), (n["sodium"] > 600, -10), (n["sugar"] > 15, -10))
    return F.greatest(F.lit(0), F.least(F.lit(100), 50 + p))


def health_categories(healthy: Column, unhealthy: Column, n: Record) -> Column:
    p = points((n["fiber"] > 5, 10), (n["protein"] > 15, 10), (n["sodium"] > 1000, -10), (n["saturated"] > 10, -10))
    return F.greatest(F.lit(0), F.least(F.lit(100), 50 + F.least(healthy * 5, F.lit(25)) - F.least(unhealthy * 3, F.lit(15)) + p))


def health_ratios(bad_share: Column, good_share: Column, per_serving: Record) -> Column:
    p = points((per_serving["saturated"] > 10, -15), (per_serving["sugar"] > 15, -15), (per_serving["sodium"] > 800, -10), (per_serving["fiber"] > 5, 10), (per_serving["protein"] > 20, 5))
    p = p + F.when(bad_share > 0.3, -15).when(bad_share > 0, -7).otherwise(0) + F.when(good_share > 0.5, 15).when(good_share > 0, 7).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 75 + p))


def effort_five(n: Column) -> Column:
    return F.when(n <= 6, 1).when(n <= 9, 2).when(n <= 12, 3).when(n <= 15, 4).otherwise(5)


def effort_three(n: Column) -> Column:
    return F.when(n <= 6, 1).when(n <= 12, 3).otherwise(5)


def effort_additive(minutes: Column, items: Column, steps: Column) -> Column:
    return F.least(F.lit(5), 1 + F.when(minutes > 120, 2).when(minutes > 60, 1).otherwise(0) + points((items > 15, 1), (steps > 10, 1)))


def notes(r: Record) -> Column:
    """A note for each failed check: category and severity."""
    note = lambda c, category, severity: F.when(c, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity")))
    return F.array_compact(F.array(
        note(~has(r, "title"), "title", "error"), note(size(r, "items") < 2, "items", "error"), note(size(r, "steps") < 1, "steps", "error"),
        note(~has(r, "servings"), "servings", "warning"), note(~(has(r, "prep") | has(r, "cook")), "times", "warning"), note(~has(r, "description"), "description", "info"),
    ))
