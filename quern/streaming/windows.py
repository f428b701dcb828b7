"""Windowed counts, exact dedup and greedy dedup over streams (extensions to the batch operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, span: str, delay: str, *keys: str) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.window(ts, span), *keys).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, ts: str, span: str, step: str, delay: str, *keys: str) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.window(ts, span, step), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, delay: str, key: str) -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def first_of_key(events: DataFrame, ts: str, delay: str, key: Column) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withColumn("_key", key).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def into(accept: Callable[[DataFrame, int], None]):
    """A foreachBatch sink: ``accept`` gets each micro-batch and its number, and must be idempotent by number."""

    def run(batch: DataFrame, number: int) -> None:
        accept(batch, number)

    return run
