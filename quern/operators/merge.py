"""Merging of partial records of one thing from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(c: Column, kind: str) -> Column:
    """Null, empty and zero count as missing."""
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind.startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def coalesced(df: DataFrame, key: str, confidence: str, seq: str, fields: list[str], tags: str | None = None, longest: list[str] = ()) -> DataFrame:
    """A row for each key: each field's first present value in order of confidence (ties by seq), tags' ordered union, and the longest lists (the first of equal ones)."""
    order = F.struct((-F.col(confidence)).alias("c"), F.col(seq).alias("s"))
    kinds = dict(df.dtypes)
    aggs = [F.min_by(F.when(present(F.col(f), kinds[f]), F.col(f)), F.when(present(F.col(f), kinds[f]), order)).alias(f) for f in fields]
    if tags:
        lists = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col(tags).alias("t")))), lambda x: x["t"])
        aggs.append(F.array_distinct(F.flatten(lists)).alias(tags))
    for name in longest:
        aggs.append(F.min_by(name, F.struct((-F.size(name)).alias("n"), order.alias("o"))).alias(name))
    aggs.append(F.floor(F.avg(confidence) + 0.5).alias(confidence))
    return df.groupBy(key).agg(*aggs)


def consulted(df: DataFrame, key: str, ord_: str, completeness: str, thresholds: list[float]) -> DataFrame:
    """The sources that a cascade asks: the n-th only if no earlier one that was asked is as complete as its threshold.

    Thresholds don't rise, so an earlier source that stops the n-th stops later
    ones too, and the greatest completeness before decides.
    """
    w = Window.partitionBy(key).orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1)
    limit = F.element_at(F.array(*map(F.lit, thresholds)), F.least(F.col(ord_) + 1, F.lit(len(thresholds))).cast("int"))
    best = F.max(completeness).over(w)
    return df.withColumn("asked", best.isNull() | (best < limit))


def cascade(*candidates: Column) -> Column:
    """The first candidate that is there."""
    return F.coalesce(*candidates)


def not_contained(base: Column, more: Column, needs: str | None = None, cut: int | None = None, both_ways: bool = False) -> Column:
    """``base`` and those items of ``more`` that none before holds (case-blind); ``needs``: a pattern that they must match; ``cut``: compare so many letters."""
    short = (lambda x: F.substring(F.lower(x), 1, cut)) if cut else (lambda x: F.lower(x))

    def add(acc: Column, x: Column) -> Column:
        known = F.exists(acc, lambda y: F.contains(F.lower(y), short(x)) | (F.contains(short(x), short(y)) if both_ways else F.lit(False)))
        fits = F.lower(x).rlike(needs) if needs else F.lit(True)
        return F.when(known | ~fits, acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(more, base, add)


def upsert(base: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins on ``key``."""
    both = base.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_b"), F.desc(version)))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_b")


def replace_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children of the parents in ``new`` give way to the new ones."""
    return children.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")
