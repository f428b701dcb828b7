"""All named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adapters, classification, extraction, fields, items, matching, merging, recipes, reports, scoring, sources, state, texts, workflow  # noqa: F401
from .registry import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracles() -> dict[str, str]:
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}
