"""Lookups in ordered dictionaries: exact, alias, containment, fuzzy, cascades.

A dictionary is a small table with an ``ord`` column: of several entries that
match, the one with the least ord wins.  Fuzzy and containment matching compares
each distinct key with each entry, so keys are made distinct first, and the
dictionary is broadcast only if ``SMALL`` bounds its rows; a larger one is joined
by Spark's own choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from .report import numbered

SMALL = 100_000


def bounded(entries: DataFrame) -> DataFrame:
    """``entries`` with a broadcast hint if it has ``SMALL`` rows at most."""
    return F.broadcast(entries) if entries.limit(SMALL + 1).count() <= SMALL else entries


def exact(left: DataFrame, key: Column, entries: DataFrame, name: str) -> DataFrame:
    return left.withColumn("_key", F.lower(F.trim(key))).join(entries.withColumn("_key", F.lower(F.trim(F.col(name)))).select("_key", F.col(name).alias("match")).distinct(), "_key", "left").drop("_key")


def by_alias(left: DataFrame, key: Column, aliases: DataFrame) -> DataFrame:
    """``aliases``: alias, name, ord."""
    first = aliases.groupBy(F.lower("alias").alias("_key")).agg(F.min_by("name", "ord").alias("match"))
    return left.withColumn("_key", F.lower(F.trim(key))).join(first, "_key", "left").drop("_key")


def first_match(keys: DataFrame, key: str, entries: DataFrame, name: str, condition: Column) -> DataFrame:
    """For each distinct key the matching entry with the least ord; keys without a match keep null."""
    found = keys.select(key).distinct().join(bounded(entries), condition).groupBy(key).agg(F.min_by(name, "ord").alias("match"))
    return keys.join(found, key, "left")


def contains_either(key: str, name: str) -> Column:
    """Either holds the other; empty keys match nothing."""
    a, b = F.lower(F.col(key)), F.lower(F.col(name))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def like_lengths(keys: DataFrame, key: str, entries: DataFrame, name: str, least: float) -> DataFrame:
    """Pairs whose lengths allow a similarity of ``least``: a key meets the entries of each such length, so the join has an equality."""
    n = F.length(key)
    lengths = F.sequence(F.ceil(least * n - 1e-9).cast("int"), F.floor(n / least + 1e-9).cast("int"))
    ranged = keys.withColumn("_length", F.explode(lengths))
    return ranged.join(bounded(entries.withColumn("_length", F.length(name))), "_length").drop("_length")


def best_match(keys: DataFrame, key: str, entries: DataFrame, name: str, score, least: float, boost: float = 0.0) -> DataFrame:
    """For each distinct key the entry with the greatest score of ``least`` at least, over 0; ties to the least ord.

    Lengths that differ too much for a similarity of ``least - boost`` aren't compared.
    """
    pairs = like_lengths(keys.select(key).distinct(), key, entries, name, least - boost).withColumn("score", score(F.col(key), F.col(name)))
    pairs = pairs.where((F.col("score") >= least) & (F.col("score") > 0))
    return pairs.groupBy(key).agg(F.max_by(F.struct(F.col(name).alias("match"), "score"), F.struct("score", -F.col("ord"))).alias("b")).select(key, "b.match", "b.score")


def cascade(keys: DataFrame, key: str, entries: DataFrame, aliases: DataFrame, name: str, least: float = 0.6) -> DataFrame:
    """Exact (1), alias (0.9), fuzzy (its score), else a new entry (0.3); later stages see only what is left."""
    todo = keys.select(key).distinct()
    one = exact(todo, F.col(key), entries, name).withColumnRenamed("match", "m1")
    two = by_alias(one, F.col(key), aliases).withColumnRenamed("match", "m2")
    left = two.where(F.col("m1").isNull() & F.col("m2").isNull())
    three = best_match(left, key, entries, name, S.similarity, least).select(key, F.col("match").alias("m3"), "score")
    out = two.join(three, key, "left")
    how = F.when(F.col("m1").isNotNull(), "exact").when(F.col("m2").isNotNull(), "alias").when(F.col("m3").isNotNull(), "fuzzy").otherwise("created")
    sure = F.when(how == "exact", 1.0).when(how == "alias", 0.9).when(how == "fuzzy", F.col("score")).otherwise(0.3)
    return out.select(key, F.coalesce("m1", "m2", "m3", F.col(key)).alias("match"), how.alias("how"), F.round(sure, 6).alias("confidence"))


def get_or_create(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """``known`` (name, id) with ids for the keys that it lacks, after its greatest, in order of name."""
    new = rows.select(F.col(key).alias("name")).distinct().join(known, "name", "left_anti")
    base = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))
    fresh = numbered(new, "name").withColumn("_k", F.lit(1)).join(F.broadcast(base.withColumn("_k", F.lit(1))), "_k")
    return known.select("name", F.col("id").cast("long")).unionByName(fresh.select("name", (F.col("base") + F.col("number")).cast("long").alias("id")))


def preferred(candidates: DataFrame, key: str, wanted: Column, ord_: str) -> DataFrame:
    """For each key the first candidate that is wanted, else its first one."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.when(wanted, 0).otherwise(1), ord_))
    return candidates.withColumn("_n", n).where("_n = 1").drop("_n")


def first_source(left: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """The value of the first source that has one; each source has the key and ``value``."""
    names = []
    for n, s in enumerate(sources):
        left = left.join(s.select(key, F.col("value").alias(f"_v{n}")), key, "left")
        names.append(f"_v{n}")
    return left.withColumn("value", F.coalesce(*names)).drop(*names)
