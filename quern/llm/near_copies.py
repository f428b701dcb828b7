"""Near duplicates by word shingles: candidates from SimHash links and from bands, decided by exact Jaccard similarity.

Texts whose sets of five-word shingles have a Jaccard similarity of ``LEAST`` or
more are near copies.  Words are those of ``simhash`` (ASCII letters lower-cased,
split at ASCII white space); a text of ``WORDS`` words or fewer is one shingle,
and texts without words are copies of each other.  Texts with equal sets are one.

Candidates are the links of ``simhash`` over the five-word fingerprints.  At a
similarity of 0.8 fingerprints differ in about ten of 64 bits, more than blocks of
them can bound, so sets that share a band are candidates too: ``BANDS`` bands of
``ROWS`` MinHash values, which a pair at 0.8 misses with probability
(1 - 0.8 ** 6) ** 40 = 5e-6, and a more similar one with less.

Each set is linked to the least set of each of its bands; the components of these
links hold all candidates.  A component goes to tasks in chunks of ``CHUNK`` bytes
of text.  A chunk compares its sets with each other and with the component's least
set by their exact similarity, skipping pairs that are linked already.  That joins
a group of near copies of any size.  Only if a component of several chunks still
falls apart, the sets outside its largest part are compared with all others of it,
a chunk of them with each chunk; so no pair of candidates goes unseen, and no task
gets more than two chunks and the least set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_key, lean, sliced, strings, table, text_key
from .simhash import Forest, hashes_of, links, majority, stars

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 40, 6
#: Bytes of text of a chunk of candidates.
CHUNK = 16 << 20
_random = np.random.default_rng(42)
_TURN = _random.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _random.integers(0, 2**31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(hashes_of(text, words))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of the set."""
    if not len(hashes):
        return []
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 128):
        np.minimum(least, ((x[i : i + 128] ^ _TURN) * _TIMES).min(axis=1), out=least)
    rows = least.astype("<u4").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42) - (1 << 63)


SKETCH = "id long, th long, size long, set long, fp long, bands array<long>"


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, th, bytes of text, set (hash of the set of shingles, as a key), fingerprint, bands of each row."""
    schema = pa.schema([*((n, pa.int64()) for n in ("id", "th", "size", "set", "fp")), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = strings(batch, "text")
            every = [hashes_of(x, WORDS) for x in texts]
            sets = [np.unique(x) for x in every]
            numbers = [[len(x) for x in texts], [set_key(s) for s in sets], np.array([majority(x) for x in every], np.uint64).view(np.int64)]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in numbers), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))], schema=schema)

    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), text_key(text).alias("th"), F.col(text).alias("text"))
    return keyed.mapInArrow(lean(run), SKETCH)


def similar(sets: list[np.ndarray], least: float = LEAST, apart: np.ndarray | None = None) -> np.ndarray:
    """Components of the sets under Jaccard similarity of ``least`` or more, each named by its least place; sets equal in ``apart`` count as linked."""
    n = len(sets)
    forest = Forest(n)
    if apart is not None:
        _, first, same = np.unique(apart, return_index=True, return_inverse=True)
        forest.join(np.arange(n), first[same])
    size = np.array([len(s) for s in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    mark = np.zeros(len(values), bool)
    for i in range(n):
        later = np.arange(i + 1, n)
        later = later[(forest.root[later] != forest.root[i]) & (np.minimum(size[later], size[i]) / np.maximum(size[later], size[i]) >= least)]
        if not len(later):
            continue
        mark[flat[starts[i] : ends[i]]] = True
        for k in range(0, len(later), 256):
            some = later[k : k + 256]
            part = np.concatenate([flat[starts[j] : ends[j]] for j in some])
            both = np.add.reduceat(mark[part], np.r_[0, np.cumsum(size[some])[:-1]], dtype=np.int64)
            near = some[both / (size[i] + size[some] - both) >= least]
            forest.join(np.full(len(near), i), near)
        mark[flat[starts[i] : ends[i]]] = False
    return forest.root


def exact(group: pa.Table) -> pa.Table:
    """Links (a, b) of the sets of a task, by their texts; sets of one ``part`` need none."""
    found, part = {}, {}
    for key, text, p in zip(*(group.column(n).to_pylist() for n in ("set", "text", "part")), strict=True):
        if key not in found:
            found[key], part[key] = shingles(text or ""), p
    keys = np.array(sorted(found), np.int64)
    parts = [part[k] for k in keys.tolist()]
    root = similar([found[k] for k in keys.tolist()], apart=None if parts[0] is None else np.array(parts, np.int64))
    own = np.flatnonzero(root != np.arange(len(keys)))
    return pa.table({"a": pa.array(keys[own], pa.int64()), "b": pa.array(keys[root[own]], pa.int64())})


LINK = "a long, b long"


def verified(texts: DataFrame, members: DataFrame, several: bool) -> DataFrame:
    """Components (fp, root) of the candidates' exact links.  ``texts``: set, group, chunk, chunks, text.  ``several``: a group has several chunks."""
    numbers = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = texts.select("group", "chunk", "set", "text")
    if several:
        rows = rows.unionByName(texts.where("set = group and chunks > 1").select("group", numbers.alias("chunk"), "set", "text"))
    found = rows.withColumn("part", F.lit(None).cast("long")).groupBy("group", "chunk").applyInArrow(exact, LINK)
    if not several:
        return table(found, "links").select(F.col("a").alias("fp"), F.col("b").alias("root"))
    found = table(found, "links")
    large = members.where("chunks > 1").select("set", "group", "size", "chunks")
    part = large.join(stars(found), F.col("set") == F.col("fp"), "left").select("set", "group", "size", "chunks", F.coalesce("root", "set").alias("part"))
    part = table(part, "parts")
    parts = part.groupBy("group", "part").agg(F.count("*").alias("n"))
    main = table(parts.groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("n")).where("n > 1").drop("n"), "main")
    if main.isEmpty():
        return stars(found)
    part = table(part.join(main, "group").withColumn("stray", F.col("part") != F.col("main")).drop("main"), "strays")
    turns = table(part.where("stray").groupBy("group").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("turns")), "turns")
    placed = table(part.join(turns, "group").select("set", "part", "stray", "turns"), "placed")
    every = texts.where("chunks > 1").join(placed.hint("shuffle_hash"), "set")
    turn = F.pmod(F.xxhash64("set", F.lit(1)), F.col("turns")).cast("int")
    against = every.select("group", "chunk", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "set", "text", "part")
    strays = every.where("stray").select("group", numbers.alias("chunk"), turn.alias("turn"), "set", "text", "part")
    more = against.unionByName(strays).groupBy("group", "chunk", "turn").applyInArrow(exact, LINK)
    return stars(found.unionByName(table(more, "links")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the least id (null last), then least text hash, of each component of near copies; of equal rows one."""
    prints = table(sketches(docs, doc_id, text), "prints")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("least")
    sets = table(prints.groupBy("set").agg(least, F.max("size").alias("size"), F.min("fp").alias("fp")), "sets")
    linked = stars(links(sets.select("fp").distinct()))
    by_print = sets.join(linked, "fp", "left").select("set", F.xxhash64(F.lit("print"), F.coalesce("root", "fp")).alias("band"))
    rows = prints.select("set", F.explode("bands").alias("band")).unionByName(by_print)
    shared = table(rows.groupBy("band").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("band", "low"), "shared")
    edges = rows.join(shared, "band").where("set <> low").select(F.col("set").alias("a"), F.col("low").alias("b"))
    groups = stars(edges).toDF("set", "group")
    groups = groups.unionByName(groups.select(F.col("group").alias("set"), "group")).distinct()
    names = [fresh(docs, "_id"), fresh(docs, "_th")]
    members = table(groups.join(sets, "set").select("set", "group", "size", id_key("least.id").alias(names[0]), F.col("least.th").alias(names[1])), "members")
    chunks = table(members.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / CHUNK)).cast("int").alias("chunks")), "chunks")
    members = table(members.join(chunks, "group"), "members")
    keyed = docs.select(F.col(text).alias("text"), id_key(doc_id).alias(names[0]), text_key(text).alias(names[1]))
    chunk = F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int").alias("chunk")
    texts = keyed.join(members.hint("shuffle_hash"), names).select("set", "group", chunk, "chunks", "text")
    roots = verified(texts, members, (chunks.agg(F.max("chunks")).first()[0] or 1) > 1)
    named = sets.drop("fp").join(roots.withColumnRenamed("fp", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    chosen = table(first.select(id_key("first.id").alias(names[0]), F.col("first.th").alias(names[1])).distinct(), "chosen")
    repeated = not prints.groupBy("id", "th").count().where("count > 1").isEmpty()
    kept = docs.withColumns({names[0]: id_key(doc_id), names[1]: text_key(text)}).join(chosen.hint("shuffle_hash"), names, "left_semi")
    return (kept.dropDuplicates(names) if repeated else kept).select(*docs.columns)
