"""Rows of several sources in one schema: unpivots, pivots, zips, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered_pairs(names: list[Column], measures: list[Column]) -> Column:
    """Column pairs to items; blank names drop out, and the order keeps their gaps."""
    each = [F.struct(F.lit(i).alias("order_index"), F.trim(n).alias("name"), F.trim(F.concat_ws(" ", F.trim(m), F.trim(n))).alias("text")) for i, (n, m) in enumerate(zip(names, measures, strict=True))]
    return F.filter(F.array(*each), lambda x: F.coalesce(x["name"], F.lit("")) != "")


def value_of(pairs: Column, name: str) -> Column:
    """The amount of the first pair of that name, case-blind."""
    return F.get(F.filter(pairs, lambda p: F.lower(p["name"]) == name.lower()), 0)["amount"]


def pivoted(df: DataFrame, key: str, name: str, value: str, names: list[str], order: str) -> DataFrame:
    """A column for each name with its first value in order; one pass, as the names are given."""
    hit = lambda n: F.lower(name) == n.lower()
    return df.groupBy(key).agg(*(F.min_by(F.when(hit(n), F.col(value)), F.when(hit(n), F.col(order))).alias(n) for n in names))


def zipped(texts: Column, details: Column) -> Column:
    """Texts with the details at their place; a missing name is the text without its leading number, "<unit>" is null."""
    bare = lambda t: F.trim(F.regexp_replace(t, r"^[0-9./\s]+", ""))
    return F.zip_with(texts, details, lambda t, d: F.struct(t.alias("text"), F.coalesce(F.nullif(d["name"], F.lit("")), bare(t)).alias("name"), F.nullif(d["unit"], F.lit("<unit>")).alias("unit")))


def per_unit(total: Column, count: Column) -> Column:
    return F.when(count > 0, F.floor(total / count + 0.5))


def listed(c: Column) -> Column:
    """A comma list to numbered items."""
    items = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(items, lambda x, i: F.struct(i.alias("order_index"), x.alias("name")))


def presence(tags: Column, items: Column, types: Column, urls: tuple[str, ...]) -> Column:
    """Any tag equal to a schema URL, any item, or any type that names a recipe."""
    return F.exists(tags, lambda x: x.isin(*urls)) | (F.size(items) > 0) | F.exists(types, lambda x: F.contains(F.lower(x), F.lit("recipe")))


def aliased(v: Column, *paths: str, default: str | None = None) -> Column:
    """The first path of a JSON text that has a value."""
    return F.coalesce(*(F.get_json_object(v, p) for p in paths), F.lit(default))


def shape(c: Column) -> Column:
    """array, object, or text."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    return F.when(v.isNull(), "text").when(F.startswith(kind, F.lit("ARRAY")), "array").when(F.startswith(kind, F.lit("OBJECT")), "object").otherwise("text")


def api_record(v: Column) -> Column:
    """A record of a nested API answer: items with amounts over zero, steps of the first analysed block, a summary without tags, named nutrients."""
    items = F.transform(v["items"], lambda x, i: F.struct(x["original"].alias("text"), F.coalesce(x["original_name"], x["name"]).alias("name"), F.when(x["amount"] > 0, x["amount"]).alias("quantity"), F.nullif(x["unit"], F.lit("")).alias("unit"), i.alias("order_index")))
    steps = F.transform(F.coalesce(F.get(v["analyzed"], 0)["steps"], F.array().cast("array<struct<number: int, step: string>>")), lambda s: F.struct(s["number"].alias("step_number"), s["step"].alias("text")))
    nutrient = lambda name: F.get(F.filter(v["nutrients"], lambda n: n["name"] == name), 0)["amount"].alias(name.lower())
    slug = F.concat(F.regexp_replace(F.lower(v["title"]), r"\s+", "-"), F.lit("-"), v["id"].cast("string"))
    return F.struct(
        v["title"].alias("title"), F.regexp_replace(v["summary"], "<[^>]*>", "").alias("description"), F.coalesce(F.nullif(v["url"], F.lit("")), slug).alias("source"), items.alias("items"), steps.alias("steps"),
        F.get(v["cuisines"], 0).alias("cuisine"), F.concat(v["cuisines"], v["dishes"], v["diets"]).alias("tags"), nutrient("Calories"), nutrient("Protein"),
    )


def linked_data(v: Column) -> dict[str, Column]:
    """Author, minutes, nutrients and tags of a linked-data JSON text, under any of their names."""
    get = lambda *paths: F.coalesce(*(F.get_json_object(v, "$." + p) for p in paths))
    raw = get("author")
    author = F.when(F.startswith(raw, F.lit("[")), get("author[0].name", "author[0]")).when(F.startswith(raw, F.lit("{")), get("author.name", "author['@name']", "author.title")).otherwise(raw)
    number = lambda *paths: F.nullif(F.regexp_extract(F.regexp_replace(get(*paths), "[^0-9.]", ""), r"^[0-9]*\.?[0-9]+", 0).try_cast("double"), F.lit(0.0))
    words = F.filter(F.transform(F.split(F.coalesce(get("keywords"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    meal = "(?i)^(breakfast|lunch|dinner|dessert|snack|appetizer|side dish)$"
    return {
        "author": author, "prep": get("prepTime.text", "prepTime", "preparationTime"), "fat": number("nutrition.fatContent", "nutrition.fat", "nutrition.Fat"),
        "protein": number("nutrition.proteinContent", "nutrition.protein", "nutrition.Protein"), "sodium": number("nutrition.sodiumContent", "nutrition.sodium", "nutrition.Sodium"),
        "meals": F.filter(words, lambda x: x.rlike(meal)), "tags": F.filter(words, lambda x: ~x.rlike(meal)),
    }


def matching(df: DataFrame, substring: Column, wanted: str, exact: Column, level: str, limit: int, *order: str) -> DataFrame:
    """Case-blind substring and equality filters, then the first rows in order."""
    return df.where(F.contains(F.lower(substring), F.lit(wanted.lower())) & (F.lower(exact) == level.lower())).orderBy(*order).limit(limit)


def details(ids: DataFrame, rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The rows of the first ids."""
    return rows.join(F.broadcast(ids.orderBy(key).limit(limit)), key, "left_semi")
