"""Line dedup by a log-template tree: lines of templates that recur across documents go.

The tree has a fixed depth.  A line goes down by its count of tokens and by its
``DEPTH`` leading tokens, tokens with digits counting as the variable field, to a
leaf.  There a line is the row of its tokens, whatever its length.

Lines of a template share all but three tenths of their tokens, so if a line of n
tokens is cut into 3 n / 10 + 1 runs, one of these is the same in all of them.  Lines
none of whose runs is in ``min_docs`` lines of the leaf have no template; that is
most prose, and it goes no further.

Of the others, a token is constant at its place if it goes with its neighbours: if
it stands in half or more (``SHARE``) of these lines of the leaf, or of those that
have the same token just before it, or just after it.  That is a share, so a slot
with many values stays variable however often each of them occurs.  Lines are counted
once for each document, and a token in fewer than ``min_docs`` of them proves nothing.

A line's template is its leaf, its constant tokens and the places of its tokens with
digits, if the constant ones are three or more, and seven tenths of the tokens without
digits.  Any other line has no template but itself, digits included, and so have
lines of under four tokens.

A template that occurs in ``min_docs`` documents or more is boilerplate: its lines
stay in the first document that has them (least id, null first, then least hash of
the text) and go from all others.  So the first of a group of copies stays whole.
Blank lines stay.  Null text stays null.  Rows that agree in id and text are one
document.  A document may end up with an empty text; its row stays.

Only counts by hash move, with combination before each shuffle; texts meet the
numbers of their lines to drop in one shuffle by document.  Tokens are 32-bit hashes
within a leaf and place, lines 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, id_key, lean, sliced, table, text_key

DEPTH, SHARE, MIN_DOCS = 2, 0.5, 5
#: Tenths of a line's plain tokens that are constant in a template, at least.
TENTHS = 7
#: Constant tokens, and tokens, that a template has at least.
CONSTANTS, SHORT = 3, 4
_DIGIT = re.compile(rb"[0-9]").search
_hash = xxhash.xxh64_intdigest
_SIGN = 1 << 63
VARIABLE = 0

LINES = "id long, th long, line int, leaf long, sig long, tokens array<int>, new int"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that isn't blank.  ``new``: 1 if its leaf, plus 2 if the line, is the document's first such one."""
    code = zlib.crc32
    for batch in sliced(batches, "text"):
        rows, flat, ends = [], [], [0]
        for i, th, text in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
            seen: set = set()
            for k, line in enumerate((text or "").encode().split(b"\n")):
                tokens = line.split()
                if not tokens:
                    continue
                sig = _hash(b" ".join(tokens)) - _SIGN
                if _DIGIT(line):
                    tokens = [b"<*>" if _DIGIT(t) else t for t in tokens]
                    flat += [VARIABLE if t == b"<*>" else code(t) or 1 for t in tokens]
                else:
                    flat += [code(t) or 1 for t in tokens]
                leaf = _hash(b"%d " % len(tokens) + b" ".join(tokens[:DEPTH])) - _SIGN
                ends.append(len(flat))
                new = (leaf not in seen) + 2 * ((leaf, sig) not in seen)
                seen.add(leaf)
                seen.add((leaf, sig))
                rows.append((i, th, k, leaf, sig, new))
        if rows:
            id_, th, line, leaf, sig, new = zip(*rows, strict=True)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.uint32).view(np.int32)))
            columns = [pa.array(x, pa.int64()) for x in (id_, th)] + [pa.array(line, pa.int32()), pa.array(leaf, pa.int64()), pa.array(sig, pa.int64()), tokens, pa.array(new, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in LINES.split(", ")])


def candidates(contents: DataFrame, min_docs: int) -> DataFrame:
    """The rows of ``contents`` (n, leaf, tokens, weight) with a run of tokens that ``min_docs`` lines of the leaf have."""
    size = F.size("tokens").cast("long")
    runs = F.floor((10 - TENTHS) * size / 10) + 1
    edge = lambda j: F.floor(size * j / runs).cast("int")
    keys = F.transform(F.sequence(F.lit(0).cast("long"), runs - 1), lambda j: F.xxhash64("leaf", j, F.slice("tokens", edge(j) + 1, edge(j + 1) - edge(j))))
    each = contents.select("n", "weight", F.explode(keys).alias("run"))
    shared = table(each.groupBy("run").agg(F.sum("weight").alias("lines")).where(F.col("lines") >= min_docs).select("run"), "runs")
    held = table(each.join(shared, "run").select("n").distinct(), "held")
    out = table(contents.join(held, "n", "left_semi"), "candidates")
    discard(shared, held)
    return out


def constants(lines: DataFrame, min_docs: int) -> DataFrame:
    """n, constants (place and token) of the lines (n, leaf, tokens, weight) that have any."""
    size = F.size("tokens")
    pairs = F.posexplode(F.arrays_zip(F.slice("tokens", F.lit(1), size - 1).alias("left"), F.slice("tokens", F.lit(2), size - 1).alias("right"))).alias("place", "pair")
    each = lines.select("n", "leaf", "weight", pairs).select("n", "leaf", "weight", "place", "pair.left", "pair.right")
    # Counts are written before they are joined, so that Spark can split a hot leaf's rows in the joins.
    both = table(each.groupBy("leaf", "place", "left", "right").agg(F.sum("weight").alias("both")), "pairs")
    left = table(both.groupBy("leaf", "place", "left").agg(F.sum("both").alias("n_left")).where(F.col("n_left") >= min_docs), "left")
    right = table(both.groupBy("leaf", "place", "right").agg(F.sum("both").alias("n_right")).where(F.col("n_right") >= min_docs), "right")
    total = table(lines.groupBy("leaf").agg(F.sum("weight").alias("total")), "totals")
    known = both.join(left, ["leaf", "place", "left"], "left").join(right, ["leaf", "place", "right"], "left").join(total, "leaf")

    def fixed(side: str, other: str):
        """Whether the token at one side is constant: by its share of the leaf, or of the lines with its neighbour."""
        own, next_ = F.col(f"n_{side}"), F.col(f"n_{other}")  # null where they are too few
        return F.coalesce((F.col(side) != VARIABLE) & own.isNotNull() & ((own >= SHARE * F.col("total")) | (F.col("both") >= SHARE * next_)), F.lit(False)).alias(f"fixed_{side}")

    known = table(known.select("leaf", "place", "left", "right", fixed("left", "right"), fixed("right", "left")).where("fixed_left OR fixed_right"), "fixed")
    discard(both, left, right, total)
    marks = F.explode(F.array_compact(F.array(F.when(F.col("fixed_left"), F.struct("place", F.col("left").alias("token"))), F.when(F.col("fixed_right"), F.struct((F.col("place") + 1).alias("place"), F.col("right").alias("token")))))).alias("mark")
    found = each.select("n", "leaf", "place", "left", "right").join(known, ["leaf", "place", "left", "right"]).select("n", marks)
    return found.groupBy("n").agg(F.sort_array(F.collect_set("mark")).alias("constants"))


def dropped(docs: DataFrame, doc_id: str, text: str, min_docs: int) -> DataFrame:
    """id, th, lines: the numbers of the lines that go."""
    keyed = docs.select(id_key(doc_id).alias("id"), text_key(text).alias("th"), F.col(text).alias("text"))
    lines = table(keyed.where(F.octet_length("text") > 0).mapInArrow(lean(scan), LINES), "lines")
    leaves = table(lines.where(F.col("new").bitwiseAND(1) == 1).groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "leaves")
    live = table(lines.join(leaves, "leaf", "left_semi"), "live")
    discard(lines, leaves)
    contents = live.where(F.col("new").bitwiseAND(2) == 2).groupBy("leaf", "sig").agg(F.first("tokens").alias("tokens"), F.count("*").alias("weight"))
    contents = table(contents.withColumn("n", F.monotonically_increasing_id()), "contents")
    marked = candidates(contents.where(F.size("tokens") >= SHORT), min_docs)
    plain, held = F.filter("tokens", lambda x: x != VARIABLE), F.size("constants")
    digits = F.transform("tokens", lambda x: x == VARIABLE)
    enough = F.coalesce((held >= CONSTANTS) & (10 * held >= TENTHS * F.size(plain)), F.lit(False))
    found = marked.join(constants(marked, min_docs), "n").where(enough).select("n", F.xxhash64("constants", digits).alias("template"))
    templates = contents.join(found, "n", "left").select("leaf", "sig", F.coalesce("template", "sig").alias("template"))
    templates = table(templates, "templates")
    discard(contents, marked)
    used = table(live.select("id", "th", "line", "leaf", "sig").join(templates, ["leaf", "sig"]).select("id", "th", "line", "leaf", "template"), "used")
    discard(live, templates)
    place = F.struct("id", "th")
    recurring = table(used.groupBy("leaf", "template").agg(F.count_distinct("id", "th").alias("docs"), F.min(place).alias("first")).where(F.col("docs") >= min_docs), "recurring")
    gone = used.join(recurring, ["leaf", "template"]).where(place != F.col("first"))
    gone = table(gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("line")).alias("lines")), "gone")
    discard(used, recurring)
    return gone


def with_dropped(docs: DataFrame, doc_id: str, text: str, min_docs: int) -> tuple[DataFrame, str]:
    gone = dropped(docs, doc_id, text, min_docs)
    names = [fresh(docs, x) for x in ("_id", "_th", "_lines")]
    gone = gone.toDF(*names).hint("shuffle_hash")
    keyed = docs.withColumns({names[0]: id_key(doc_id), names[1]: text_key(text)})
    return keyed.join(gone, names[:2], "left").drop(*names[:2]), names[2]


def without(text: str, lines) -> str:
    gone = set(lines)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def drop_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``."""
    joined, lines = with_dropped(docs, doc_id, text, min_docs)

    @F.pandas_udf("string")
    def kept(texts, numbers):
        return pd.Series([x if x is None or n is None else without(x, n) for x, n in zip(texts, numbers, strict=True)], dtype=object)

    return joined.withColumn(text, F.when(F.col(lines).isNull(), F.col(text)).otherwise(kept(text, lines))).select(*docs.columns)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars, kept_sha256 of each row."""
    joined, lines = with_dropped(docs.select(doc_id, text), doc_id, text, min_docs)
    ddl = "doc_id long, n_lines long, n_dropped long, kept_chars long, kept_sha256 string"
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in ddl.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            rows = []
            for x, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, gone = x or "", gone or []
                left = without(x, gone) if gone else x
                rows.append((x.count("\n") + 1, len(gone), len(left), hashlib.sha256(left.encode()).hexdigest()))
            if rows:
                yield pa.record_batch([batch.column(0).cast(pa.int64()), *(list(c) for c in zip(*rows, strict=True))], schema=schema)

    return joined.select(doc_id, text, lines).mapInArrow(run, ddl)
