"""Traversal of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps of ``start`` (node) along ``edges`` (a, b), with their least depth.

    A step joins the last level only; visited nodes drop out, so cycles end.
    """
    level = start.select("node", F.lit(0).alias("depth"))
    seen = stored(level)
    level = seen
    for n in range(1, depth + 1):
        found = level.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        level = stored(found.join(seen, "node", "left_anti").select("node", F.lit(n).alias("depth")))
        if level.isEmpty():
            break
        seen = stored(seen.unionByName(level))
    return seen
