"""Exact top-k by inner product over vector-approximation files.

Vectors are turned into integers, floor(scale * x), and each row gets a number.  Two
tables are written: the exact vectors by row, and the approximation file, whose rows
are blocks of up to ``BLOCK`` vectors: their ids, row numbers, and for each component
a cell of one byte between the block's least and greatest value.

Queries go out in batches of ``BATCH`` bytes.  For a batch the tasks read the cells
only: a cell's centre and half width bound each inner product from both sides, and a
block returns what its own k-th greatest lower bound doesn't rule out.  The k-th
greatest lower bound over all blocks cuts that down once more.  Exact vectors are
read for the survivors alone: first those with the k greatest upper bounds, whose
k-th score then rules out most of the others, then the rest, whose upper bounds
reach it.  No candidate's vector moves but for that; what moves is a few numbers for
each query and block.

Of equal vectors only the k + 1 with the least ids can be results (one of them may
be the query), so groups of copies cost no more than that.

Rows with a null id, a null vector or a null or non-finite component take no part.
Rows that repeat an id are rows of their own: each is a query if the id is one, and
a candidate for all rows but itself.  Ties go to lesser ids.  A query meets the
candidates of its own dimension.  Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

CELLS = 256
#: Vectors of a block; bytes of the queries of a batch; queries compared with a block at a time.
BLOCK, BATCH, GROUP = 8192, 16 << 20, 256


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with vector ``b``."""
    limit = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, len(b))
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if limit < 2**53 else a @ b


def _matrix(values: pa.Array, n: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


FILE = "size int, ids binary, rows binary, low binary, half binary, cells binary"


def _approximate(got: pa.Table) -> pa.Table:
    """A block's row of the file."""
    n = got.num_rows
    vectors = _matrix(got["vector"].combine_chunks(), n).astype(float)
    low, high = vectors.min(0), vectors.max(0)
    half = np.maximum((high - low) / (2 * CELLS), 1e-9)
    cells = np.minimum((vectors - low) / (2 * half), CELLS - 1).astype(np.uint8)
    parts = (got["id"].to_numpy(), got["row"].to_numpy(), low, half, cells)
    return pa.table({"size": pa.array([vectors.shape[1]], pa.int32()), **{k: [x.tobytes()] for k, x in zip(("ids", "rows", "low", "half", "cells"), parts, strict=True)}})


BOUNDS = "query long, id long, row long, lower double, upper double"


def _scan(batch: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """For each query and block the candidates that the cells' bounds leave; ``batch``: by dimension, the queries' row numbers and vectors."""

    def bounds(block: dict) -> Iterator[tuple[np.ndarray, ...]]:
        rows, vectors = batch[block["size"]]
        own, ids = np.frombuffer(block["rows"], np.int64), np.frombuffer(block["ids"], np.int64)
        low, half = np.frombuffer(block["low"]), np.frombuffer(block["half"])
        centres = low + (2.0 * np.frombuffer(block["cells"], np.uint8).reshape(len(ids), -1) + 1) * half
        top = np.abs(centres).max(0, initial=0) + 1
        for i in range(0, len(rows), GROUP):
            q = vectors[i : i + GROUP].astype(float)
            near = q @ centres.T
            slack = np.abs(q) @ half * (1 + 1e-9) + 1e-9 * (np.abs(q) @ top) + 1e-6
            near[rows[i : i + GROUP, None] == own] = -np.inf
            m = min(k, len(ids))
            least = np.partition(near, len(ids) - m, axis=1)[:, len(ids) - m]
            a, b = np.nonzero((near >= (least - 2 * slack)[:, None]) & (near > -np.inf))
            yield rows[i : i + GROUP][a], ids[b], own[b], near[a, b] - slack[a], near[a, b] + slack[a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BOUNDS.split(", ")]
        for given in batches:
            for block in given.to_pylist():
                if block["size"] in batch:
                    for found in bounds(block):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)

    return run


def _scored(pairs: DataFrame, used: DataFrame, batch: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """query, id, score of ``pairs`` (query, id, row), by the exact vectors."""
    at = {size: (rows[order := np.argsort(rows)], vectors[order]) for size, (rows, vectors) in batch.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            sizes = pa.compute.list_value_length(given.column(2)).to_numpy()
            for size in np.unique(sizes).tolist():
                part = given.filter(pa.array(sizes == size))
                rows, vectors = at[size]
                mine = vectors[np.searchsorted(rows, part.column(0).to_numpy())]
                theirs = _matrix(part.column(2), part.num_rows)
                limit = float(np.abs(mine).max(initial=0)) * float(np.abs(theirs).max(initial=0)) * max(1, size)
                score = (mine.astype(float) * theirs).sum(1).astype(np.int64) if limit < 2**53 else (mine * theirs).sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.int64())], ["query", "id", "score"])

    rows = pairs.select("query", "id", "row").join(used.select("row", "vector"), "row").select("query", "id", "vector")
    return rows.mapInArrow(run, "query long, id long, score long")


def _first(column: str, descending: str, *ties: str) -> Column:
    return F.row_number().over(Window.partitionBy(column).orderBy(F.desc(descending), *ties))


def _search(file: DataFrame, used: DataFrame, batch: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """query, rank, id, score for a batch of queries."""
    left = table(file.mapInArrow(_scan(batch, k), BOUNDS), "bounds")
    least = left.withColumn("n", _first("query", "lower")).where(F.col("n") <= k).groupBy("query").agg(F.min("lower").alias("least"), F.count("*").alias("n"))
    least = least.select("query", F.when(F.col("n") == k, F.col("least")).otherwise(float("-inf")).alias("least"))
    left = table(left.join(least, "query").where("upper >= least").withColumn("n", _first("query", "upper", "id", "row")).drop("least", "lower"), "survivors")
    sure = table(_scored(left.where(F.col("n") <= k), used, batch), "scores")
    reached = sure.groupBy("query").agg(F.min("score").alias("reached"))
    rest = left.where(F.col("n") > k).join(reached, "query").where("upper >= reached")
    found = sure.unionByName(_scored(rest, used, batch))
    return found.withColumn("rank", _first("query", "score", "id")).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def _batches(asked: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries in batches of ``BATCH`` bytes; the driver holds one at a time."""
    held: dict[int, list] = {}
    size = 0

    def out() -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {n: (np.array([r for r, _ in x], np.int64), np.array([v for _, v in x], np.int64).reshape(len(x), n)) for n, x in held.items()}

    for row, vector in asked.select("row", "vector").toLocalIterator():
        held.setdefault(len(vector), []).append((row, vector))
        size += 8 * len(vector) + 16
        if size >= BATCH:
            yield out()
            held, size = {}, 0
    if held:
        yield out()


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of each row where ``queries`` holds, ties to lesser ids."""
    spark = vectors.sparkSession
    used = vectors.where(F.col(vec_id).isNotNull() & finite(F.col(embedding)))
    used = used.select(F.col(vec_id).cast("long").alias("id"), integers(F.col(embedding), scale).alias("vector"), F.coalesce(queries, F.lit(False)).alias("query"))
    used = table(used.withColumn("row", F.monotonically_increasing_id()), "vectors")
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("id", "row"))
    chosen = used.select("id", "row", "vector").withColumn("copy", copy).where(F.col("copy") <= k + 1)
    blocks = max(1, -(-used.count() // BLOCK))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    file = table(chosen.select(F.size("vector").alias("size"), block, "id", "row", "vector").groupBy("size", "block").applyInArrow(_approximate, FILE), "file")
    asked = used.where("query").select("id", "row", "vector")
    found = [table(_search(file, used, batch, k), "found") for batch in _batches(asked)]
    out = spark.createDataFrame([], "query long, rank int, id long, score long")
    for x in found:
        out = out.unionByName(x)
    named = out.join(asked.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query")
    return named.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
