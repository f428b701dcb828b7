"""Sum-of-squares packing of token sequences into sequences of ``size`` tokens.

A document is its text's ids and an end id.  Only a document over ``size`` tokens
is cut: its first piece takes the remainder, the others are full.  Full pieces
fill a sequence each.  The others are placed, longest first, where the sum of
squares of the counts of open bins per residual gap becomes least; that keeps
gaps of all sizes in store.  Ties go to the least gap.

Placing needs the pieces' lengths only, so the corpus is summarised by a
histogram (``size`` counts).  The driver packs rounds of at most ``ROUND`` pieces
whose lengths are in the corpus' proportions, and one round's plan serves as
many rounds as the histogram holds; what is left over is packed in the same way.
Each piece then finds its place by its rank among the pieces of its length,
numbered by task and then within the task.

Pure sum-of-squares leaves the small gaps that it keeps in store open at the end
of a finite list, so the shortest pieces can be placed by best fit; the plan
tries a few limits, 0 (none) among them, and keeps the one with fewest bins.

Null text counts as empty: a document of the end id alone.  Null and repeated ids
are packed like others, each row a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, sliced, strings, table
from .merge_automaton import MergeAutomaton
from .token_counts import SLICE
from .token_counts import ids as ids_of
from .vocabulary import default_path

SIZE, END = 1024, 2
#: Pieces planned at a time; bounds the plan that tasks get: 8 bytes a piece.
ROUND = 1 << 20
FINISH = (0, 300, 400)
_FAR = 1 << 60


def place_sizes(counts: np.ndarray, size: int, finish: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Pack ``counts[s]`` pieces of each length s < ``size``: bins, and each piece's bin and offset, by length."""
    gaps = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    total = int(counts.sum())
    where, offset = np.empty(total, np.int32), np.empty(total, np.int32)
    first = np.cumsum(counts) - counts
    bins = 0
    for s in range(len(counts) - 1, 0, -1):
        for k in range(int(first[s]), int(first[s] + counts[s])):
            if s > finish:
                change = 1 - 2 * gaps[s:]
                change[1:] += 2 * gaps[1 : size - s + 1] + 1
                change[gaps[s:] == 0] = _FAR
                change[size - s] = 2 * gaps[size - s] + 1
                g = int(change.argmin()) + s
            else:
                fit = gaps[s:] > 0
                g = int(fit.argmax()) + s
                if not gaps[g]:
                    g = size
            if g == size:
                b = bins
                bins += 1
            else:
                gaps[g] -= 1
                b = stacks[g].pop()
            if g > s:
                gaps[g - s] += 1
                stacks[g - s].append(b)
            where[k], offset[k] = b, size - g
    return bins, where, offset


def plan(histogram: np.ndarray, size: int, limit: int = ROUND) -> list[dict]:
    """Layers: ``times`` rounds of ``counts`` pieces each, their plan, and the layer's first sequence."""
    left, layers, sequence = histogram.astype(np.int64).copy(), [], 0
    while left.sum():
        times = max(1, -(-int(left.sum()) // limit))
        counts = left // times
        if not counts.sum():  # fewer of each length than rounds
            times, counts = 1, np.minimum(left, max(1, limit // len(left)))
        bins, where, offset = min((place_sizes(counts, size, f) for f in FINISH), key=lambda x: x[0])
        layers.append({"times": times, "counts": counts, "bins": bins, "where": where, "offset": offset, "sequence": sequence})
        sequence += bins * times
        left -= counts * times
    return layers


def locate(layers: list[dict], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the piece of each length and rank."""
    sequence, offset = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
    rank = rank.copy()
    todo = np.ones(len(length), bool)
    for x in layers:
        counts = x["counts"]
        first = np.cumsum(counts) - counts
        here = todo & (rank < counts[length] * x["times"])
        q = counts[length[here]]
        turn, k = rank[here] // q, rank[here] % q + first[length[here]]
        sequence[here] = x["sequence"] + turn * x["bins"] + x["where"][k]
        offset[here] = x["offset"][k]
        todo &= ~here
        rank[todo] -= counts[length[todo]] * x["times"]
    return sequence, offset


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, number long"


def pieces(docs: DataFrame, doc_id: str, text: str, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in PIECES.split(", "))])
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64).tolist()
        for batch in sliced(batches, "text", SLICE):
            rows = []
            for i, ids in zip(batch.column(0).to_pylist(), ids_of(strings(batch, "text"), tokenizer), strict=True):
                ids += last
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    to = at + ((n - at - 1) % size + 1 if not k else size)
                    rows.append((i, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to]), part, seen[to - at]))
                    seen[to - at] += 1
                    at, k = to, k + 1
            if rows:
                yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=schema)
        MergeAutomaton.of(tokenizer).rest()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), PIECES)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    cut = table(pieces(docs, doc_id, text, tokenizer or default_path("byte_bpe_50k.json"), size, end), "pieces")
    counts = cut.groupBy("part", "length").agg(F.max("number").alias("last"))
    before = F.coalesce(F.sum(F.col("last") + 1).over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = table(counts.withColumn("before", before), "counts")
    histogram = np.zeros(size + 1, np.int64)
    for n, c in counts.groupBy("length").agg(F.sum(F.col("last") + 1)).collect():  # a row for each length
        histogram[n] = c
    full = int(histogram[size])
    shared = spark.sparkContext.broadcast(plan(histogram[:size], size))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    schema = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in out.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)
            short = length < size
            a, b = locate(shared.value, length[short], rank[short])
            sequence[short], offset[short] = a + full, b
            yield pa.record_batch([*(batch.column(n) for n in ("doc_id", "piece", "start")), length, batch.column("ids_crc32"), sequence, offset], schema=schema)

    # a row for each task and length: it goes where a task's pieces are, and its size has a bound
    ranked = cut.join(counts.select("part", "length", "before"), ["part", "length"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank")).mapInArrow(run, out)
