"""SimHash fingerprints and their links, by a self-join over binary tries.

A text's words (ASCII letters lower-cased, split at ASCII white space) give
shingles of ``words`` words, repeats included; a shorter text gives one shingle,
a text without words fingerprint zero.  A bit is set if it is set in over half
of the shingles' XXH64 hashes (seed 42).

Two fingerprints that differ in ``BUDGET`` bits agree in one of the BUDGET + 1
blocks of 16 bits at least, so each distinct fingerprint goes to a task for each
block, turned so that this block leads (a block's value that very many share is
dealt on by sub-blocks of the other bits).  There the sorted array is a binary trie
whose nodes are index ranges.  Pairs of nodes go down together, bit by bit; a
pair that has used up its budget of differing bits, or whose leaves are all in
one component by then, is dropped.  A task returns a spanning forest, not all
pairs, so that a dense group costs a row for each fingerprint.

Null text counts as empty, null id as absent (a component of null ids only has a
null id).  Rows that repeat an id get the same component if their texts link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_key, lean, partitions, sliced, strings, table, text_key

BUDGET, BLOCK = 3, 16
#: Bits beside a block, and of each of their sub-blocks.
REST, SUB = 48, 12
#: Fingerprints meant for a task, and those of one prefix that are dealt on.
TASK, CROWD = 1 << 20, 1 << 19
#: Node pairs taken down a level at a time.
FRONT = 1 << 17


def hashes_of(text: str, words: int) -> np.ndarray:
    """Hashes of the shingles of ``words`` words, in order, repeats included."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    hash_ = xxhash.xxh64_intdigest
    n = len(found) - words + 1
    return np.fromiter((hash_(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int = 3) -> int:
    return majority(hashes_of(text, words))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """id, th (hash of the text, as a key), fp (signed) of each row."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            got = np.array([fingerprint(x, words) for x in strings(batch, "text")], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), got.view(np.int64)], schema=schema)

    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), text_key(text).alias("th"), F.col(text).alias("text"))
    return keyed.mapInArrow(lean(run), "id long, th long, fp long")


class Forest:
    """Components of 0..n-1, each named by its least member."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def trie_components(x: np.ndarray, lead: int, budget: int = BUDGET) -> np.ndarray:
    """Components of the sorted distinct ``x`` under links between members that share ``lead`` leading bits."""
    n = len(x)
    forest = Forest(n)
    if n < 2:
        return forest.root
    top = x >> np.uint64(64 - lead)
    first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    last = np.r_[first[1:], n]
    big = last - first > 1
    zero = np.zeros(big.sum(), np.int64)
    stack = [(lead, np.stack([first[big], last[big], first[big], last[big], zero]))]
    while stack:
        depth, front = stack.pop()
        if front.shape[1] > FRONT:
            stack += [(depth, front[:, i : i + FRONT]) for i in range(0, front.shape[1], FRONT)]
            continue
        change = np.r_[0, np.cumsum(forest.root[1:] != forest.root[:-1])]
        a, b, c, d, used = front
        whole = (change[a] == change[b - 1]) & (change[c] == change[d - 1]) & (forest.root[a] == forest.root[c])
        front = front[:, ~whole]
        a, b, c, d, used = front
        same = a == c
        small = (b - a) * (d - c) <= 16
        if small.any():
            m = np.flatnonzero(small)
            size = ((b - a) * (d - c))[m]
            of = np.repeat(m, size)
            k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            i, j = a[of] + k // (d - c)[of], c[of] + k % (d - c)[of]
            near = (i != j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
            forest.join(i[near], j[near])
        a, b, c, d, used = front[:, ~small]
        same = same[~small]
        if not len(a):
            continue
        bit = np.uint64(63 - depth)

        def middle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return np.clip(np.searchsorted(x, ((x[lo] >> bit) | np.uint64(1)) << bit), lo, hi)

        p, q = middle(a, b), middle(c, d)
        more = used + 1
        parts = [(a, p, c, q, used), (p, b, q, d, used), (a, p, q, d, more), (p[~same], b[~same], c[~same], q[~same], more[~same])]
        down = np.concatenate([np.stack(t) for t in parts], axis=1)
        alive = (down[1] > down[0]) & (down[3] > down[2]) & (down[4] <= budget)
        down = down[:, alive]
        if down.shape[1]:
            stack.append((depth + 1, down))
    return forest.root


def _dealt(fps: DataFrame) -> DataFrame:
    """The fingerprints turned for each block, and which block and sub-block leads; rows of a crowded prefix once for each sub-block.

    Two fingerprints that share a block differ in ``BUDGET`` of the other 48 bits, so they agree in one of BUDGET + 1
    sub-blocks of those, too: a prefix that many share is dealt on by its sub-blocks, and no link gets lost.
    """
    turned = [F.col("fp") if not k else F.shiftleft("fp", BLOCK * k).bitwiseOR(F.shiftrightunsigned("fp", 64 - BLOCK * k)) for k in range(BUDGET + 1)]
    rows = fps.select(F.posexplode(F.array(*turned)).alias("block", "turned")).withColumn("prefix", F.shiftrightunsigned("turned", REST))
    crowded = table(rows.groupBy("block", "prefix").count().where(F.col("count") > CROWD).select("block", "prefix", F.lit(True).alias("crowded")), "crowded")
    if crowded.isEmpty():
        return rows.select("block", F.lit(-1).alias("sub"), "turned", F.col("prefix").alias("key"))
    rows = rows.join(crowded, ["block", "prefix"], "left").withColumn("sub", F.explode(F.when(F.col("crowded"), F.array(*map(F.lit, range(BUDGET + 1)))).otherwise(F.array(F.lit(-1)))))
    low = F.col("turned").bitwiseAND((1 << REST) - 1)
    by = lambda k: F.shiftleft(low, k).bitwiseOR(F.shiftright(low, REST - k)).bitwiseAND((1 << REST) - 1).bitwiseOR(F.shiftleft("prefix", REST))
    again = F.col("turned")
    for j in range(1, BUDGET + 1):
        again = F.when(F.col("sub") == j, by(SUB * j)).otherwise(again)
    key = F.when(F.col("sub") < 0, F.col("prefix")).otherwise(F.shiftrightunsigned(again, REST - SUB))
    return rows.select("block", "sub", again.alias("turned"), key.alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a spanning forest for each block, of the distinct fingerprints ``fps`` (fp)."""
    n = max(partitions(fps.sparkSession), -(-(BUDGET + 1) * fps.count() // TASK))
    rows = _dealt(fps).repartition(n, "block", "sub", "key").select("block", "sub", "turned")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            block, sub, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k, j in np.unique(np.stack([block, sub], axis=1), axis=0).tolist():
                parts.setdefault((k, j), []).append(value[(block == k) & (sub == j)].view(np.uint64))
        for (k, j), part in parts.items():
            x = np.unique(np.concatenate(part))
            root = trie_components(x, BLOCK if j < 0 else BLOCK + SUB)
            own = np.flatnonzero(root != np.arange(len(x)))
            back = [unturned(v, k, j) for v in (x[own], x[root[own]])]
            yield pa.record_batch([v.view(np.int64) for v in back], schema=schema)

    return rows.mapInArrow(run, "a long, b long")


def unturned(value: np.ndarray, block: int, sub: int) -> np.ndarray:
    """The fingerprints that were turned so that ``block``, and after it ``sub`` if there is one, lead."""
    if sub > 0:
        rest, k = np.uint64((1 << REST) - 1), SUB * sub
        low = value & rest
        value = value & ~rest | (low >> np.uint64(k) | low << np.uint64(REST - k)) & rest
    turn = BLOCK * block
    return value >> np.uint64(turn) | value << np.uint64(64 - turn) if turn else value


def stars(edges: DataFrame) -> DataFrame:
    """Components of ``edges`` (a, b) as rows (fp, root), by alternating large and small stars; roots have no row.

    Each least neighbour is written before it is joined, so both sides of the join are plain and a hot node's rows can be split.
    """
    edges = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = table(edges, "large")
        least = table(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = table(small, "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def components(prints: DataFrame) -> DataFrame:
    """fp, component_id (least id of the fingerprint's component) and least_th (that id's least text hash)."""
    distinct = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("least"))
    distinct = table(distinct, "fingerprints")
    roots = stars(links(distinct.select("fp")))
    named = table(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    least = table(named.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    return named.join(least, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.th").alias("least_th"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row."""
    prints = table(fingerprints(docs, doc_id, text, words), "prints")
    return prints.join(components(prints), "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The row with the least id (null last), then least text hash, of each component; of equal rows one."""
    prints = table(fingerprints(docs, doc_id, text, words), "prints")
    names = [fresh(docs, "_id"), fresh(docs, "_th")]
    chosen = table(components(prints).select(id_key("component_id").alias(names[0]), F.col("least_th").alias(names[1])).distinct(), "chosen")
    repeated = not prints.groupBy("id", "th").count().where("count > 1").isEmpty()
    kept = docs.withColumns({names[0]: id_key(doc_id), names[1]: text_key(text)}).join(chosen.hint("shuffle_hash"), names, "left_semi")
    return (kept.dropDuplicates(names) if repeated else kept).select(*docs.columns)
