"""Duplicates by key and by similarity, and greedy acceptance in order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..session import discard, stored


def first_of_key(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """The first row of each key; rows without a key stay."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    return df.withColumn("_n", F.when(key.isNull(), 1).otherwise(n)).where("_n = 1").drop("_n")


#: Counters of tokens, by hash: what is rare goes first.
COUNTERS = 1 << 18
#: Numbers of 64 parities that ride along with the rarest tokens.
FOLD = 2
FOLDED = [f"p{i}" for i in range(FOLD)]
#: Sizes of parts, largest first: larger sets go in 2, 4, 8, ... parts of as many tokens.
PARTS = (128, 64, 32, 16)
#: Rounds in which pairs are sought, and tokens of all sets from which on there is one more: a round joins its share of the tokens.
ROUNDS, ROUND_TOKENS = 4, 1 << 22
#: Rows of which sketches are made at once.
SLICE = 1000


def part_size(least: float) -> int:
    """The largest part that the parities can tell apart: what parts as similar as ``least`` may differ in is four deviations below what unlike ones do."""
    bits = 64 * FOLD
    told = [n for n in PARTS if bits / 2 * (1 - (1 - 2 / bits) ** (2 * n)) - 2 * n * (1 - least) / (1 + least) >= 2 * bits**0.5]
    return told[0] if told else PARTS[-1]


def _sketches(counts: np.ndarray, least: float):
    """For each part of each row of token hashes its size, the rarest of them and parities of the hashes."""

    whole = part_size(least)

    def levels(sizes: np.ndarray) -> np.ndarray:
        return np.ceil(np.log2(np.maximum(sizes / whole, 1))).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
            column = given.column(1)
            sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            top, low = levels(sizes), levels(np.ceil(least * sizes - 1e-9))
            order = np.lexsort((flat, counts[flat & (COUNTERS - 1)], row))
            row, flat = row[order], flat[order]
            for down in range(int((top - low).max()) + 1):
                level = top - down
                use = (level >= low)[row]
                r, h = row[use], flat[use]
                part = (h >> 20) & ((1 << level[r]) - 1)
                order = np.lexsort((part, r))  # stable: rare tokens stay first
                r, h, part = r[order], h[order], part[order]
                begins = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (part[1:] != part[:-1])]))
                n = np.diff(np.concatenate([begins, [len(h)]]))
                kept = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
                prefix = h[np.arange(len(h)) - np.repeat(begins, n) < np.repeat(kept, n)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(prefix))
                bits = np.repeat(np.arange(len(n)), n) * (64 * FOLD) + (h & (64 * FOLD - 1))
                parity = (np.bincount(bits, minlength=len(n) * 64 * FOLD) & 1).astype(np.uint8).reshape(-1, 64 * FOLD)
                folded = np.ascontiguousarray(np.packbits(parity, axis=1).view(np.int64).T)
                of = r[begins]
                columns = [pa.array(x, pa.int32()) for x in (sizes[of], level[of], n)]
                yield pa.RecordBatch.from_arrays([given.column(0).take(pa.array(of)), *columns, lists, *map(pa.array, folded)], ["id", "size", "level", "n", "prefix", *FOLDED])

    return run


#: Of rows with one least neighbour so many are held against as many others at once, and so many tokens make a group of these blocks.
BLOCK, GROUP_TOKENS = 128, 1 << 20


def _scores(least: float):
    """Pairs of a group whose sets are similar enough; with them come the sets, each once."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        t = sets["t"].combine_chunks()
        size = pa.compute.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
        words = t.flatten().dictionary_encode()
        word, has = words.indices.to_numpy(zero_copy_only=False), np.zeros(len(words.dictionary), bool)
        begin = np.concatenate([[0], np.cumsum(size)])
        a, b = (pa.compute.index_in(pairs[x], value_set=sets["id"]).to_numpy().astype(np.int64) for x in ("a", "b"))
        order = np.argsort(a, kind="stable")
        a, b, shared = a[order], b[order], np.empty(len(a), np.int64)
        for i in range(0, len(a), BLOCK):
            cuts = i + np.flatnonzero(np.diff(a[i : i + BLOCK], prepend=-1, append=-1))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                one, n = word[begin[a[x]] : begin[a[x] + 1]], size[b[x:y]]
                has[one] = True
                at = np.cumsum(n) - n
                shared[x:y] = np.add.reduceat(has[word[np.arange(n.sum()) + np.repeat(begin[b[x:y]] - at, n)]].astype(np.int64), at)
                has[one] = False
        similarity = shared / (size[a] + size[b] - shared)
        found = similarity >= least
        got = pairs.select(["a", "b"]).take(pa.array(order[found]))
        return got.append_column("similarity", pa.array(similarity[found]))

    return run


def _scored(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a < b) of rows of ``sets`` (id, t) with their similarity, where it is ``least`` at least.

    Pairs go to groups by blocks of rows that have their least neighbour in common, so a
    set is sent once for each block that its own block meets, not once for each pair.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    ends = pairs.select(F.col("b").alias("id"), F.col("a").alias("lead")).unionByName(pairs.select(F.col("a").alias("id"), F.col("a").alias("lead")))
    leads = stored(ends.groupBy("id").agg(F.min("lead").alias("lead")))
    chunks = leads.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    rows = stored(leads.join(chunks, "lead").select("id", "lead", F.pmod(F.xxhash64("id"), "chunks").alias("chunk")))
    blocks = [rows.select(F.col("id").alias(x), F.struct("lead", "chunk").alias(f"block_{x}")) for x in ("a", "b")]
    dealt = stored(pairs.join(blocks[0], "a").join(blocks[1], "b").select("a", "b", F.xxhash64("block_a", "block_b").alias("block")))
    whole = stored(sets.join(leads.select("id"), "id", "left_semi"))
    met = dealt.select("block", F.explode(F.array("a", "b")).alias("id")).distinct()
    tokens = met.join(whole.select("id", F.size("t").alias("n")), "id").agg(F.sum("n")).first()[0] or 0
    group = F.pmod("block", F.lit(tokens // GROUP_TOKENS + 1)).alias("group")
    sent = met.select(group, "id").distinct().join(whole, "id")
    out = dealt.select(group, "a", "b").groupBy("group").cogroup(sent.groupBy("group"))
    out = stored(out.applyInArrow(_scores(least), f"a {kind}, b {kind}, similarity double"))
    discard(leads, rows, dealt, whole)
    return out


def digest(items: str) -> Column:
    """Of an array as a set."""
    return F.sha2(F.to_json(F.sort_array(F.array_distinct(items))), 256)


def token_pairs(df: DataFrame, seq: str, tokens: str, least: float) -> DataFrame:
    """Pairs (a < b) of rows with Jaccard similarity of ``least`` at least.

    Exact, by parts, prefix and place.  Tokens are dealt to parts by their hashes, to as
    many as the smaller of two sets calls for; if two sets are that similar, so are their
    tokens of one part at least (if all parts differed by more than that share of their
    sizes, so would the sets).  Tokens of a part are ordered by rarity, and two parts
    that similar share one of each one's first n - ceil(least * n) + 1 tokens; from the
    first that they share on, as many as they must share are left of both.  Tokens are
    hashes of 32 bits there, and
    rarity is that of a counter: tokens that share a hash share more, never less, and
    any one order will do.  Pairs that are found so have their parities compared (a
    token in one set only changes one bit at most), those of the part, which ride
    along; parts are as small as that takes (``part_size``).  The tokens themselves are
    joined to what is left.  Rows with equal sets are one while pairs are sought, so
    copies cost no more.  What is joined is written before, so Spark can split the rows
    of a frequent token; ``df`` is read anew for each step that needs whole sets.
    Tokens are joined in rounds, each over its share of them, so that only that share
    lies on disk at once; a round leaves out the pairs of those before.
    """
    kind = df.schema[seq].dataType.simpleString()
    sets = df.select(F.col(seq).alias("id"), F.array_distinct(tokens).alias("t"))
    hashes = F.transform("t", lambda x: F.shiftright(F.xxhash64(x), 32).cast("int"))
    written = stored(sets.select("id", digest("t").alias("set"), hashes.alias("h")))
    hashed = written.where(F.size("h") > 0)  # of what is written: on the sets it would make them twice
    first = stored(hashed.groupBy("set").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    counted = hashed.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(COUNTERS - 1)).alias("h")).count()
    got = counted.toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[got["h"].to_numpy()] = got["count"].to_numpy()
    kinds = f"id {kind}, size int, level int, n int, prefix array<int>, " + ", ".join(f"{x} long" for x in FOLDED)
    sketch = hashed.select("id", "h").mapInArrow(_sketches(counts, least), kinds)
    sketch = stored(sketch.join(first.select(F.col("first").alias("id")), "id", "left_semi"))
    copies = hashed.select("id", "set").join(first.where("copies > 1"), "set").where("id <> first")
    copies = stored(copies.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    discard(written, first)
    near = (F.col("a.token") == F.col("b.token")) & (F.col("a.level") == F.col("b.level")) & (F.col("a.id") < F.col("b.id"))
    smaller, parts = F.least("a.size", "b.size"), F.expr("shiftleft(1L, a.level)")
    part = part_size(least)
    near &= (smaller <= part * parts) & ((F.col("a.level") == 0) | (2 * smaller > part * parts))
    for n in ("size", "n"):
        near &= F.col(f"b.{n}").between(F.ceil(least * F.col(f"a.{n}") - 1e-9), F.floor(F.col(f"a.{n}") / least + 1e-9))
    left = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    near &= left >= F.ceil(least / (1 + least) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) for x in FOLDED])
    near &= apart <= (F.col("a.n") + F.col("b.n")) * ((1 - least) / (1 + least)) + 1e-6
    prefix = sketch.select("id", "size", "n", *FOLDED, "level", F.posexplode("prefix").alias("place", "token"))
    rounds, found = min(ROUNDS, int(counts.sum()) // ROUND_TOKENS + 1), []
    for i in range(rounds):
        rows = prefix.where(F.pmod("token", F.lit(rounds)) == i)
        pairs = rows.alias("a").join(rows.alias("b"), near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
        if found:
            pairs = pairs.join(reduce(DataFrame.unionByName, found), ["a", "b"], "left_anti")
        found.append(stored(pairs))
    discard(sketch)
    scored = _scored(reduce(DataFrame.unionByName, found), sets, least)
    discard(*found)
    return scored.unionByName(copies)


def composite(title_a: Column, title_b: Column, items_a: Column, items_b: Column) -> Column:
    return S.similarity(title_a, title_b, empty=0.0) * 0.6 + S.jaccard(items_a, items_b) * 0.4


def composite_need(least: float = 0.85) -> float:
    """What similarity of items a composite score of ``least`` needs: titles give 0.6 at most."""
    return (least - 0.6) / 0.4


def composite_pairs(df: DataFrame, seq: str, title: str, items: str, least: float = 0.85, links: DataFrame | None = None) -> DataFrame:
    """Pairs (a < b) whose composite score is ``least`` at least.

    Titles give 0.6 at most, so items must have a similarity of ``composite_need``: pairs come from ``token_pairs``, or
    ``links`` are these pairs.  Rows of equal sets count by their first row there, so each pair of rows that one link stands
    for is scored by its own titles: rows are joined to the sets' firsts, a title once for each set.  Items stay where they
    are; a digest stands for them.
    """
    rows = stored(df.select(F.col(seq).alias("id"), F.col(title).alias("k"), digest(items).alias("set"), (F.size(items) > 0).alias("filled")))
    titles = rows.groupBy("set", "k").agg(F.min("id").alias("id"), F.first("filled").alias("filled"))
    firsts = stored(titles.withColumn("first", F.min("id").over(Window.partitionBy("set"))))
    links = token_pairs(df, seq, items, composite_need(least)) if links is None else links
    links = links.select("a", "b", "similarity").join(firsts.select(F.col("first").alias("b")).distinct(), "b", "left_semi").select("a", "b", "similarity")
    own = firsts.where("filled").select(F.col("first").alias("a"), F.col("first").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    links = stored(links.unionByName(own))
    one = firsts.select(F.col("first").alias("a"), F.col("id").alias("x"), F.col("k").alias("kx"))
    two = firsts.select(F.col("first").alias("b"), F.col("id").alias("y"), F.col("k").alias("ky"))
    need = (F.lit(least) - F.col("similarity") * 0.4) / 0.6
    score = S.similarity_from(F.col("kx"), F.col("ky"), need, empty=0.0) * 0.6 + F.col("similarity") * 0.4
    found = links.join(one, "a").join(two, "b").where("a <> b OR x < y").withColumn("score", score).where(F.col("score") >= least)
    found = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")
    copies = rows.join(firsts.select("set", "k", F.col("id").alias("a")), ["set", "k"]).where("id <> a")
    same = F.when(F.length("k") > 0, 0.6).otherwise(0.0) + F.when(F.col("filled"), 0.4).otherwise(0.0)
    copies = copies.select("a", F.col("id").alias("b"), same.alias("score")).where(F.col("score") >= least)
    return found.unionByName(copies)


def greedy(rows: DataFrame, edges: DataFrame, seq: str) -> DataFrame:
    """Rows kept when each is accepted unless it is like one accepted before: the first maximal independent set in order.

    Rounds: a row is accepted once no undecided or accepted earlier neighbour is
    left, and its later neighbours are rejected.  ``edges``: a < b, of sequence
    numbers.  Each round's state is written, so nothing is held on the driver.

    An edge of similarity 1 (where ``edges`` says it, as those of ``token_pairs``)
    ends in a copy.  What is like the earlier row is like the copy, so the copy is
    rejected in any case, and only rows that are no copies take part in the rounds.
    """
    state = stored(rows.select(F.col(seq).alias("id")).join(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"))
    rejected = [state.where("false")]
    live = edges.select("a", "b").distinct()
    if "similarity" in edges.columns:
        copies = stored(edges.where("similarity = 1").select(F.col("b").alias("id")).distinct())
        rejected.append(copies)
        for end in ("a", "b"):
            live = live.join(copies.withColumnRenamed("id", end), end, "left_anti")
        live = live.select("a", "b")
    live = stored(live)
    while not live.isEmpty():
        blocked = live.select(F.col("b").alias("id")).distinct()
        accepted = live.select(F.col("a").alias("id")).distinct().join(blocked, "id", "left_anti")
        out = stored(live.join(accepted, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct())
        rejected.append(out)
        gone = live.join(out.withColumnRenamed("id", "a"), "a", "left_anti")
        live = stored(gone.join(out.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))
    return rows.join(reduce(DataFrame.unionByName, rejected).withColumnRenamed("id", seq), seq, "left_anti")


def match_type(title: Column, url: Column, items: Column, both: Column) -> Column:
    """The first stage that finds a duplicate."""
    return F.when(title, "title").when(url, "url").when(items, "ingredients").when(both, "composite")
