"""Queries over the true dictionaries, on recipes and item names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import items as I
from ..functions import recipes as R
from ..functions import vocabularies as V
from .registry import query

# id, title, description, items, steps, tags, prep, cook, effort
RECIPES = [
    (1, "Spaghetti Carbonara", "A quick dinner", ["spaghetti", "pancetta", "eggs", "parmesan cheese", "black pepper"], ["Boil the pasta for 10 minutes", "Fry the pancetta", "Stir in eggs and cheese"], ["pasta"], 10, 20, 2),
    (2, "Vegan Thai Green Curry", "Plant-based and warming", ["coconut milk", "green curry paste", "tofu", "jasmine rice", "lime"], ["Simmer the curry for 25 minutes", "Steam the rice"], ["vegan", "dairy-free"], 15, 25, 3),
    (3, "Roast Chicken", "", ["whole chicken", "butter", "fresh rosemary", "sea salt"], ["Preheat oven to 200 degrees", "Roast for 2 hours"], [], 15, 120, 4),
    (4, "Fruit Salad", "Fresh and light", ["apples", "berries", "honey", "mint"], ["Chop and mix", "Chill"], ["summer"], 10, 0, 1),
    (5, "Pancakes with Bacon", "Sunday brunch for kids and family", ["flour", "milk", "eggs", "bacon", "maple syrup"], ["Mix flour and milk", "Fry in a skillet"], [], 5, 10, 1),
    (6, "Keto Salmon", "low carb, gluten-free", ["salmon", "olive oil", "lemon", "herbs"], ["Grill the salmon for 12 minutes"], ["keto"], 5, 12, 2),
    (7, "Plain", "", ["water"], ["Wait"], [], 0, 60, 3),
    (8, "Nothing", "", [], [], [], 20, 20, 3),
    (9, "Smoked Lamb", "It's a celebration with za'atar", ["lamb shoulder", "za'atar", "tahini", "yogurt", "mint", "pita", "sumac", "dates", "bulgur"], ["Marinate overnight", "Smoke for 6 hours", "Refrigerate and cool"], ["easter"], 60, 360, 5),
]
NAMES = ["all-purpose flour", "Red Wine", "ground beef", "fresh salmon fillet", "Greek yogurt", "green onions", "peanut butter", "sea salt", "curry spice mix", "water", "coconut", "butternut squash", "oil", "", "chicken stock", "pineapple", "sugar", "rose water", "extra virgin olive oil", "whole milk"]
AMOUNTS = [(1, 2.0, "eggs", "eggs"), (2, 1.5, "cups", "all-purpose flour"), (3, 3.0, "Tbsp", "olive oil"), (4, 8.0, "oz", "cheddar"), (5, 1.0, "lb", "beef"), (6, 2.0, "pounds", "beef"), (7, 1.0, "handful", "spinach"), (8, 0.5, "l", "milk"), (9, 2.0, "boxes", "pasta"), (10, 1.0, "kilograms", "rice"), (11, 3.0, "cloves", "garlic"), (12, None, "cup", "water"), (13, 1.0, None, "water"), (14, 2.5, "tsp", "honey")]
SCHEMA = "id int, title string, description string, items array<string>, steps array<string>, tags array<string>, prep int, cook int, effort int"


def text(x):
    return "'" + x.replace("'", "''") + "'"


def list_of(values):
    return "[" + ", ".join(map(text, values)) + "]::VARCHAR[]"


ROWS = "(VALUES " + ", ".join(f"({i}, {text(t)}, {text(d)}, {list_of(m)}, {list_of(s)}, {list_of(g)}, {p}, {c}, {e})" for i, t, d, m, s, g, p, c, e in RECIPES) + ") r(id, title, description, items, steps, tags, prep, cook, effort)"
ALL = f"(SELECT *, lower(title || ' ' || description || ' ' || array_to_string(items, ' ') || ' ' || array_to_string(steps, ' ')) AS t FROM {ROWS})"


def recipes(t):
    rows = t.rows(RECIPES, SCHEMA)
    return rows.withColumn("t", F.concat_ws(" ", "title", "description", F.array_join("items", " "), F.array_join("steps", " ")))


def hits(words, c="t"):
    return "(" + " + ".join(f"CAST(contains({c}, {text(w)}) AS INT)" for w in words) + ")"


def present(family, least=1, c="t"):
    return "[x for x in [" + ", ".join(f"CASE WHEN {hits(words, c)} >= {least} THEN {text(name)} END" for name, words in family.items()) + "] if x IS NOT NULL]"


def either(words, names="names"):
    return f"len([x for x in {names} if len([w for w in {list_of(words)} if contains(x, w) OR contains(w, x)]) > 0]) > 0"


STAGES = " ".join(f"WHEN {hits(words, 'lower(name)')} > 0 THEN {text(n)}" for stage in (V.PRIORITY, V.CATEGORIES, V.PATTERNS) for n, words in stage.items())


@query(f"SELECT name, CASE {STAGES} ELSE 'Other' END AS category FROM (SELECT unnest({list_of(NAMES)}) AS name)")
def item_categories(t):
    return t.rows([(n,) for n in NAMES], "name string").select("name", R.category(F.col("name")).alias("category"))


CUISINES = f"""(SELECT *, CASE WHEN len(found) > 0 THEN found WHEN contains(t, 'pasta') OR contains(t, 'pizza') THEN ['Italian'] WHEN contains(t, 'rice') AND (contains(t, 'soy') OR contains(t, 'ginger')) THEN ['Asian']
  WHEN contains(t, 'olive oil') AND contains(t, 'herbs') THEN ['Mediterranean'] ELSE ['International'] END AS cuisines FROM (SELECT *, {present(V.CUISINES, 2)} AS found FROM {ALL}))"""


@query(f"SELECT id, array_to_string(cuisines, '|') AS cuisines FROM {CUISINES}")
def recipe_cuisines(t):
    return recipes(t).select("id", F.array_join(R.cuisines(F.col("t")), "|").alias("cuisines"))


MEALS = f"""(SELECT * EXCLUDE (named), CASE WHEN len(more) > 0 THEN more WHEN prep + cook > 45 OR len(items) > 8 THEN ['Dinner'] ELSE ['Lunch'] END AS meals FROM (SELECT *, named || CASE WHEN prep + cook <= 15 AND NOT list_contains(named, 'Snack') THEN ['Snack'] ELSE [] END
  || CASE WHEN len([x for x in items if contains(lower(x), 'egg') OR contains(lower(x), 'bacon')]) > 0 AND NOT list_contains(named, 'Breakfast') THEN ['Breakfast'] ELSE [] END AS more FROM (SELECT *, {present(V.MEALS)} AS named FROM {CUISINES})))"""


@query(f"SELECT id, array_to_string(meals, '|') AS meals FROM {MEALS}")
def recipe_meals(t):
    meals = C.meal_types(F.col("t"), V.MEALS, F.col("items"), F.col("prep") + F.col("cook"))
    return recipes(t).select("id", F.array_join(meals, "|").alias("meals"))


LEVEL = "[CASE WHEN effort <= 2 AND prep + cook <= 30 THEN 'Easy' WHEN effort >= 4 OR prep + cook > 120 THEN 'Advanced' ELSE 'Intermediate' END]"
FIRST = "[upper(w[1]) || w[2:] for w in [string_split(x, ' ')[1] for x in items[1:3]] if length(w) > 3]"


@query(f"""SELECT id, array_to_string([x for x, i in every if list_position(every, x) = i], '|') AS tags FROM (SELECT id, {present(V.TAGS['Cooking Methods'])} || {LEVEL} || {present(V.TAGS['Occasion'])} || {present(V.TAGS['Dietary'])} || {present(V.TAGS['Season'])}
  || {FIRST} || [x for x in cuisines if x <> 'International'] || meals AS every FROM {MEALS})""")
def recipe_tags(t):
    text_, minutes = F.col("t"), F.col("prep") + F.col("cook")
    found = R.tags(text_, F.col("items"), F.col("effort"), minutes, R.cuisines(text_), C.meal_types(text_, V.MEALS, F.col("items"), minutes))
    return recipes(t).select("id", F.array_join(found, "|").alias("tags"))


BROKEN = {name: hits(words, "lower(array_to_string(items, ' | '))") for name, (_, words) in V.DIETS.items()}
RULES = ", ".join(f"CASE WHEN {hits(words, 'said')} > 0 OR {BROKEN[name]} = 0 THEN {text(name)} END" for name, (words, _) in V.DIETS.items())


@query(f"SELECT id, array_to_string([x for x in [{RULES}] if x IS NOT NULL][1:10], '|') AS diets, CAST(len([x for x in items if {hits(V.DIETS['Ketogenic'][1], 'lower(x)')} > 0]) AS INTEGER) AS broken FROM (SELECT *, lower(title || ' ' || description || ' ' || array_to_string(tags, ' ')) AS said FROM {ROWS})")
def recipe_diets(t):
    said = F.concat_ws(" ", "title", "description", F.array_join("tags", " "))
    return recipes(t).select("id", F.array_join(C.eligible(F.col("items"), said, V.DIETS), "|").alias("diets"), F.size(C.violations(F.col("items"), V.DIETS["Ketogenic"][1])).alias("broken"))


CLEAN = f"[x for x in [trim(regexp_replace(regexp_replace(regexp_replace(lower(y), '[®™©]', '', 'g'), '\\b({R.DESCRIPTORS})\\b', '', 'g'), '\\s+', ' ', 'g')) for y in items] if x <> '']"


def sql_suitable():
    has, part = either, lambda words: f"len([x for x in names if {hits(words, 'x')} > 0]) > 0"
    meat, sea, dairy, egg, salty, heavy = (has(w) for w in (V.MEAT, V.SEAFOOD, V.DAIRY, V.EGG, V.HIGH_SODIUM, V.HIGH_CARB))
    rules = {
        "Gluten-Free": f"NOT {has(V.GLUTEN)}", "Dairy-Free": f"NOT {dairy}", "Lactose-Intolerant": f"NOT {dairy}", "Nut-Free": f"NOT {has(V.NUT)}", "Peanut-Free": f"NOT {has(V.PEANUT)}", "Soy-Free": f"NOT {has(V.SOY)}",
        "Egg-Free": f"NOT {egg}", "Shellfish-Free": f"NOT {has(V.SHELLFISH)}", "Fish-Free": f"NOT {sea}", "Vegetarian": f"NOT {meat} AND NOT {sea}", "Vegan": f"NOT {meat} AND NOT {sea} AND NOT {dairy} AND NOT {egg} AND NOT {part(V.ANIMAL)}",
        "Pescatarian": f"NOT {meat} AND {sea}", "Ketogenic": f"prep < 10 AND cook >= 15 AND NOT {heavy}", "Low Carb": f"prep < 20 AND NOT {heavy}", "Low Sodium": f"NOT {salty} OR effort / 10 < 0.14",
        "Kosher": f"NOT {has(V.NOT_KOSHER)} AND NOT ({meat} AND {dairy})", "Halal": f"NOT {has(V.NOT_HALAL)}", "Paleo": f"NOT {has(V.NOT_PALEO)}", "Sugar-Free": f"NOT {has(V.SUGAR)}", "Heart-Healthy": f"{part(V.WHOLESOME)} AND NOT {salty} AND NOT {part(V.UNWHOLESOME)}",
    }
    return "[x for x in [" + ", ".join(f"CASE WHEN {rules[n]} THEN {text(n)} END" for n in R.SUITABLE) + "] if x IS NOT NULL]"


@query(f"""SELECT id, array_to_string(found, '|') AS suitable, array_to_string([x for x in found if NOT (x = 'Vegetarian' AND list_contains(found, 'Vegan') OR x = 'Low Carb' AND list_contains(found, 'Ketogenic'))], '|') AS validated
  FROM (SELECT id, CASE WHEN len(items) = 0 THEN [] ELSE {sql_suitable()} END AS found FROM (SELECT *, {CLEAN} AS names FROM {ROWS}))""")
def recipe_suitability(t):
    """prep, cook and effort / 10 stand for carbohydrates, fat and sodium."""
    found = R.suitable(F.col("items"), F.col("prep"), F.col("cook"), F.col("effort") / 10)
    return recipes(t).select("id", F.array_join(found, "|").alias("suitable"), F.array_join(R.validated(found), "|").alias("validated"))


def sql_methods():
    out = []
    for k, (name, words) in enumerate(V.METHODS.items()):
        factor = V.METHOD_WEIGHTS.get(name, 5) * (2.5 if name in V.HEAT else 1.0)
        weight = f"(1 + (i - 1) / len(steps) * 2) * CASE WHEN regexp_matches(lower(s), 'minutes|hours|°|degrees') THEN 2.0 ELSE 1.0 END * {hits(words, 'lower(s)')}"
        out.append(f"{{'score': round(coalesce(list_sum(list_transform(steps, lambda s, i: {weight})), 0) * {factor}, 6)::DOUBLE, 'first': -list_position([{hits(words, 'lower(s)')} > 0 for s in steps], true), 'ord': {-k}, 'name': {text(V.METHOD_NAMES[name])}, 'heat': {str(name in V.HEAT).lower()}}}")
    return "[m for m in [" + ", ".join(out) + "] if m.score > 0]"


@query(f"""SELECT id, CASE WHEN len(steps) = 0 THEN 'No Method' WHEN top IS NULL THEN 'Mixed' WHEN NOT top.heat AND hot IS NOT NULL AND hot.score > 0.3 * top.score THEN hot.name ELSE top.name END AS method
  FROM (SELECT id, steps, list_max(found) AS top, list_max([m for m in found if m.heat]) AS hot FROM (SELECT id, steps, {sql_methods()} AS found FROM {ROWS}))""")
def recipe_method(t):
    return recipes(t).select("id", R.cooking_method(F.col("steps")).alias("method"))


@query(f"SELECT id, array_to_string([x for x, i in every if list_position(every, x) = i], '|') AS methods FROM (SELECT id, flatten([{present({V.METHOD_NAMES[k]: w for k, w in V.METHODS.items()}, 1, 'lower(s)').replace('[x for x in', '[y for y in').replace('if x IS', 'if y IS')} for s in steps]) AS every FROM {ROWS})")
def recipe_methods(t):
    return recipes(t).select("id", F.array_join(R.methods(F.col("steps")), "|").alias("methods"))


DENSITIES = "(VALUES " + ", ".join(f"({text(k)}, {v}, {i})" for i, (k, v) in enumerate(V.DENSITIES.items())) + ") d(k, v, ord)"


@query(f"SELECT name, coalesce((SELECT arg_min(v, ord) FROM {DENSITIES} WHERE name <> '' AND (contains(lower(trim(name)), k) OR contains(k, lower(trim(name))))), 1.0)::DOUBLE AS density FROM (SELECT unnest({list_of(NAMES)}) AS name)")
def item_densities(t):
    return t.rows([(n,) for n in NAMES], "name string").select("name", I.density(F.col("name"), V.DENSITIES).alias("density"))


def pairs_of(values):
    return "(VALUES " + ", ".join(f"({text(k)}, {v})" for k, v in values.items()) + ")"


@query("SELECT id, coalesce(quantity * p.g, floor(quantity * coalesce(m.ml * coalesce((SELECT arg_min(v, ord) FROM " + DENSITIES + " WHERE contains(name, k) OR contains(k, name)), 1.0), w.g) * 100 + 0.5) / 100)::DOUBLE AS grams FROM (VALUES "
  + ", ".join(f"({i}, {'NULL' if q is None else q}::DOUBLE, {'NULL' if u is None else text(u)}, {text(n)})" for i, q, u, n in AMOUNTS)
  + f") a(id, quantity, unit, name) LEFT JOIN {pairs_of(V.PIECES)} p(u, g) ON p.u = lower(unit) LEFT JOIN {pairs_of(R.MILLILITRES)} m(u, ml) ON m.u = lower(unit) LEFT JOIN {pairs_of(R.WEIGHTS)} w(u, g) ON w.u = lower(unit)")
def item_grams(t):
    rows = t.rows(AMOUNTS, "id int, quantity double, unit string, name string")
    return rows.select("id", R.grams(F.col("quantity"), F.col("unit"), I.density(F.col("name"), V.DENSITIES)).alias("grams"))


LINES = ["2 cups all-purpose flour, sifted", "1 tsp freshly ground black pepper", "3 large Roma tomatoes (diced tomatoes work too)", "2 tbsp sesame oil", "500 g ricotta cheese", "1 cup diced tomatoes"]
COMPOUND = "(VALUES " + ", ".join(f"({text(k)}, {i})" for i, k in enumerate(V.COMPOUNDS)) + ") c(k, ord)"


@query(f"SELECT line, (SELECT arg_min(k, ord) FROM {COMPOUND} WHERE contains(lower(split_part(regexp_replace(line, '\\([^)]*\\)', '', 'g'), ',', 1)), k)) AS name FROM (SELECT unnest({list_of([x for x in LINES if 'Roma' not in x])}) AS line) UNION ALL SELECT {text(LINES[2])}, 'roma'")
def compound_names(t):
    rows = t.rows([(x,) for x in LINES], "line string")
    return rows.select("line", I.core_name(F.col("line"), F.lit(1.0), V.COMPOUNDS).alias("name"))


ITEM_UNITS = {f"{i} {u}": g for i, units in V.ITEM_GRAMS.items() for u, g in units.items()}
MEASURES = [(1, 2.0, "cup", "flour"), (2, 2.0, "cup", "rice"), (3, 3.0, "tbsp", "oil"), (4, 1.0, "box", "pasta"), (5, 0.5, "Cups", "sugar"), (6, 0.0, "g", "salt"), (7, 1.5, "oz", "butter"), (8, None, "cup", "milk"), (9, 2.0, "pinches", "salt"), (10, 1.0, None, "water")]


@query("SELECT id, round(quantity * coalesce(i.g, u.g, 100.0), 6)::DOUBLE AS by_item, CAST(floor(nullif(quantity, 0) * s.g + 0.5) AS BIGINT) AS simple FROM (VALUES "
  + ", ".join(f"({i}, {'NULL' if q is None else q}::DOUBLE, {'NULL' if u is None else text(u)}, {text(n)})" for i, q, u, n in MEASURES)
  + f") a(id, quantity, unit, name) LEFT JOIN {pairs_of(ITEM_UNITS)} i(k, g) ON i.k = name || ' ' || unit LEFT JOIN {pairs_of(V.UNIT_GRAMS)} u(k, g) ON u.k = unit LEFT JOIN {pairs_of(V.SIMPLE_GRAMS)} s(k, g) ON s.k = lower(unit)")
def unit_variants(t):
    rows = t.rows(MEASURES, "id int, quantity double, unit string, name string")
    q, u = F.col("quantity"), F.col("unit")
    return rows.select("id", F.round(R.grams_by_item(q, u, F.col("name")), 6).alias("by_item"), R.simple_grams(q, u).alias("simple"))


HOSTS = ["allrecipes.com", "www.delish.com", "campbells.com", "my-kitchen.org", ""]


@query(f"SELECT host, coalesce(a.v, string_split(bare, '.')[1] || ' Chef') AS author FROM (SELECT host, regexp_replace(host, '^www[.]', '') AS bare FROM (SELECT unnest({list_of([h for h in HOSTS if h])}) AS host)) LEFT JOIN (VALUES " + ", ".join(f"({text(k)}, {text(v)})" for k, v in V.SITE_AUTHORS.items()) + ") a(k, v) ON a.k = bare")
def site_authors(t):
    return t.rows([(h,) for h in HOSTS if h], "host string").select("host", I.site_author(F.col("host"), V.SITE_AUTHORS).alias("author"))
