"""Exact removal of repeated passages: a byte goes if a string of ``width`` bytes that covers it also starts earlier.

Every window of ``width`` bytes has an anchor (see ``anchors``), and equal
windows have equal anchors at equal offsets.  So the corpus needs no full suffix
array: its sparse suffix array over the anchors suffices.

1.  Each task hashes its texts' anchors and, for each, the bytes of all windows
    that the anchor stands for (its context).  Of equal contexts in a task all
    but the first are settled at once; one row for each other goes to the bucket
    of its gram's hash, so a group of copies shrinks to a row a task.
2.  A bucket settles all contexts but the first of equal ones.  First ones whose
    gram has other contexts too may share some windows only: they stay open.
3.  Open contexts come together by gram.  The suffixes that start at the anchors
    and the left sides, read backwards, are put in order by deep-shallow sorting;
    neighbours' common prefixes give the windows that contexts share, in time that
    grows with their number.  So that no task gets a gram of any size, one with over
    ``LARGE`` contexts sends its windows' 128-bit hashes through a Spark aggregation
    instead, which combines them before the shuffle.
4.  The settled byte ranges join the documents by key and are cut.

Order of texts: by id (null first), then by hash of the text.  Rows that agree in
both are one document: each gets the same answer.  Null text counts as empty.
Texts under ``width`` bytes lose nothing.  Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Hashes, anchors, mixed
from .common import fresh, id_key, lean, partitions, pieces_of, strings, table, text_key
from .suffix_sort import deep_shallow_sort

GRAM = 32
#: Contexts of one gram that are sorted together at most, and of several grams that are looked at together.
LARGE, TOGETHER = 4096, 4096
#: Bytes of text whose anchors a bucket gets.
BUCKET = 64 << 20
#: Bytes of text hashed at a time, and anchors held before they are sent.
CHUNK, HELD = 1 << 18, 1 << 19

_DOC = np.dtype([("id", "<i8"), ("th", "<i8")])
_ROW = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i4"), ("lo", "<i4"), ("off", "<u2"), ("run", "<u2")])
_SPAN = np.dtype([("id", "<i8"), ("th", "<i8"), ("start", "<i4"), ("end", "<i4")])
_OPEN = np.dtype([("h", "<u8"), ("at", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("large", "<i4")])
_WINDOW = np.dtype([("w1", "<i8"), ("w2", "<i8"), ("id", "<i8"), ("th", "<i8"), ("at", "<i4")])
_RANGE = np.dtype([("start", "<i4"), ("end", "<i4")])

SCANNED = "bucket int, docs binary, rows binary, spans binary"
SETTLED = "id long, th long, spans binary, open binary"
CONTEXTS = "large boolean, g1 long, g2 long, id long, th long, at int, lo int, hi int, context binary"


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans sorted by document and start, with overlapping ones of a document joined.  Ends don't fall as starts rise."""
    if not len(spans):
        return spans
    new = np.r_[True, (spans["id"][1:] != spans["id"][:-1]) | (spans["th"][1:] != spans["th"][:-1]) | (spans["start"][1:] > spans["end"][:-1])]
    first = np.flatnonzero(new)
    out = spans[first].copy()
    out["end"] = spans["end"][np.r_[first[1:], len(spans)] - 1]
    return out


def _firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of gram, context, document and place; which begin a gram; which are (a copy of) a context's first."""
    rows = rows[np.lexsort((rows["lo"], rows["doc"], rows["c"], rows["h"]))]
    gram = np.r_[True, rows["h"][1:] != rows["h"][:-1]]
    context = gram | np.r_[True, rows["c"][1:] != rows["c"][:-1]]
    of = np.flatnonzero(context)[np.cumsum(context) - 1]
    return rows, gram, (rows["doc"] == rows["doc"][of]) & (rows["lo"] == rows["lo"][of])


def _spans(rows: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    rows = rows[np.lexsort((rows["lo"], rows["doc"]))]
    out = np.empty(len(rows), _SPAN)
    out["id"], out["th"] = docs["id"][rows["doc"]], docs["th"][rows["doc"]]
    out["start"], out["end"] = rows["lo"], rows["lo"] + rows["run"] + width
    return _merged(out)


def _groups(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    ends = np.searchsorted(keys[order], np.arange(n + 1))
    for k in range(n):
        if ends[k] < ends[k + 1]:
            yield k, order[ends[k] : ends[k + 1]]


def scan(width: int, gram: int, buckets: int):
    def flush(docs: list[tuple[int, int]], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        own = np.array(docs, _DOC)
        unique, number = np.unique(own, return_inverse=True)
        rows = np.concatenate(parts)
        rows["doc"] = number[rows["doc"]]
        rows, _, first = _firsts(rows)
        spans, rows = _spans(rows[~first], unique, width), rows[first]
        by_row = dict(_groups((rows["h"] % np.uint64(buckets)).astype(np.int64), buckets))
        by_span = dict(_groups((spans["th"] % buckets).astype(np.int64), buckets))
        for b in sorted(by_row.keys() | by_span.keys()):
            part = rows[by_row.get(b, [])]
            used, part["doc"] = np.unique(part["doc"], return_inverse=True)
            yield pa.record_batch([[b], [unique[used].tobytes()], [part.tobytes()], [spans[by_span.get(b, [])].tobytes()]], schema=_schema(SCANNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int]] = []
        parts: list[np.ndarray] = []
        held = 0

        def take(keys: list, texts: list[bytes]) -> None:
            nonlocal held
            data = np.frombuffer(b"".join(texts), np.uint8)
            bounds = np.r_[0, np.cumsum([len(x) for x in texts])]
            if len(data) < width:
                return
            hashes = Hashes(data)
            text, at, lo, hi, h = anchors(data, bounds, width, gram, hashes)
            rows = np.empty(len(h), _ROW)
            rows["h"] = h
            rows["c"] = mixed(hashes.of(1, lo, hi + width) ^ ((at - lo) * 1024 + hi - lo).astype(np.uint64))
            rows["doc"], rows["lo"], rows["off"], rows["run"] = text + len(docs), lo - bounds[text], at - lo, hi - lo
            docs.extend(keys)
            parts.append(rows)
            held += len(rows)

        for batch in batches:
            keys: list = []
            texts: list[bytes] = []
            size = 0
            for i, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch, batch.schema.names[2]), strict=True):
                data = text.encode()
                if len(data) < width:
                    continue
                keys.append((i, th))
                texts.append(data)
                size += len(data)
                if size >= CHUNK:
                    take(keys, texts)
                    keys, texts, size = [], [], 0
                    if held >= HELD:
                        yield from flush(docs, parts)
                        docs, parts, held = [], [], 0
            take(keys, texts)
        yield from flush(docs, parts)

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def settle(width: int, large: int):
    def run(got: pa.Table) -> pa.Table:
        docs = [np.frombuffer(x, _DOC) for x in got["docs"].to_pylist()]
        parts = [np.frombuffer(x, _ROW) for x in got["rows"].to_pylist()]
        spans = [np.frombuffer(x, _SPAN) for x in got["spans"].to_pylist()]
        unique, number = np.unique(np.concatenate(docs), return_inverse=True)
        rows = np.concatenate(parts)
        shift = np.repeat(np.cumsum([0, *map(len, docs[:-1])]), [len(x) for x in parts])
        rows["doc"] = number[rows["doc"] + shift] if len(rows) else rows["doc"]
        rows, gram, first = _firsts(rows) if len(rows) else (rows, np.empty(0, bool), np.empty(0, bool))
        spans.append(_spans(rows[~first], unique, width))
        which = np.cumsum(gram) - 1
        new = np.r_[True, (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1])][: len(rows)]
        contexts = np.bincount(which, weights=new)[which] if len(rows) else np.empty(0)
        more = first & new & (contexts > 1)
        left = np.empty(more.sum(), _OPEN)
        left["h"], left["lo"] = rows["h"][more], rows["lo"][more]
        left["at"], left["hi"] = left["lo"] + rows["off"][more], left["lo"] + rows["run"][more]
        left["large"] = contexts[more] > large
        found: dict[tuple[int, int], list] = {}
        for k, x in (("spans", np.concatenate(spans)), ("open", None)):
            if k == "spans":
                keys, own = np.unique(x[["id", "th"]], return_inverse=True)
                x, place = x[["start", "end"]].astype(_RANGE), 0
            else:
                keys, own = np.unique(unique[rows["doc"][more]], return_inverse=True)
                x, place = left, 1
            for n, at in _groups(own, len(keys)):
                found.setdefault((int(keys[n]["id"]), int(keys[n]["th"])), [None, None])[place] = x[at].tobytes()
        return pa.table([[k[0] for k in found], [k[1] for k in found], [v[0] for v in found.values()], [v[1] for v in found.values()]], schema=_schema(SETTLED))

    return run


def contexts(width: int):
    """The open contexts of each text.  For grams with many, the hashes of their windows, each task's first of equal ones; the others are settled."""
    schema = _schema(CONTEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["at"], rows["th"], rows["id"], rows["w2"], rows["w1"]))]
            new = np.r_[True, (rows["w1"][1:] != rows["w1"][:-1]) | (rows["w2"][1:] != rows["w2"][:-1])]
            of = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = (rows["at"] != rows["at"][of]) | (rows["id"] != rows["id"][of]) | (rows["th"] != rows["th"][of])
            first, late = rows[new], rows[again]
            n = len(first)
            yield pa.record_batch([pa.array([True] * n), first["w1"], first["w2"], first["id"], first["th"], first["at"], first["at"], first["at"], pa.nulls(n, pa.binary())], schema=schema)
            late = late[np.lexsort((late["at"], late["th"], late["id"]))]
            spans = np.empty(len(late), _SPAN)
            spans["id"], spans["th"], spans["start"], spans["end"] = late["id"], late["th"], late["at"], late["at"] + width
            spans = _merged(spans)
            keys, own = np.unique(spans[["id", "th"]], return_inverse=True)
            cut_ = [spans[["start", "end"]][at].astype(_RANGE).tobytes() for _, at in _groups(own, len(keys))]
            n, zero = len(keys), np.zeros(len(keys), "<i4")
            yield pa.record_batch([pa.nulls(n, pa.bool_()), zero.astype("<i8"), zero.astype("<i8"), keys["id"].copy(), keys["th"].copy(), zero, zero, zero, pa.array(cut_, pa.binary())], schema=schema)

        for batch in batches:
            for i, th, text, opened in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                data = (text or "").encode()
                rows = np.concatenate([np.frombuffer(x, _OPEN) for x in opened])
                small, large = rows[rows["large"] == 0], rows[rows["large"] == 1]
                n = len(small)
                if n:
                    parts = [data[a : b + width] for a, b in zip(small["lo"].tolist(), small["hi"].tolist(), strict=True)]
                    yield pa.record_batch([pa.array([False] * n), small["h"].view("<i8"), np.zeros(n, "<i8"), np.full(n, i), np.full(n, th), small["at"], small["lo"], small["hi"], pa.array(parts, pa.binary())], schema=schema)
                if len(large):
                    start = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(large["lo"].tolist(), large["hi"].tolist(), strict=True)]))
                    hashes = Hashes(np.frombuffer(data, np.uint8))
                    got = np.empty(len(start), _WINDOW)
                    got["w1"], got["w2"] = hashes.of(0, start, start + width).view("<i8"), hashes.of(1, start, start + width).view("<i8")
                    got["id"], got["th"], got["at"] = i, th, start
                    held.append(got)
                    size += len(got)
                    if size >= HELD:
                        yield from flush()
                        held, size = [], 0
        yield from flush()

    return run


def shared_windows(groups: list[list[tuple]], width: int) -> np.ndarray:
    """Byte ranges of the contexts (id, th, at, lo, hi, bytes) of each gram that an earlier one of the same gram has too.

    A window begins ``a`` bytes before its anchor.  Two contexts share it if the suffixes at their anchors agree in
    ``width - a`` bytes and their left sides, read backwards, in ``a``.  Both are sorted; in the order, runs of neighbours
    with so long a common prefix are the classes of equal ones, for all values of ``a`` at once.
    """
    rows = [x for g in groups for x in g]
    ids, ths, at, lo, hi = (np.array([r[k] for r in rows], np.int64) for k in range(5))
    _, rank = np.unique(np.rec.fromarrays([ids, ths, at]), return_inverse=True)
    a = np.arange(int((at - lo).max()) + 1)
    classes = []
    for depth, side in ((width - a, lambda r: r[5][r[2] - r[3] :]), (a, lambda r: r[5][: r[2] - r[3]][::-1])):
        order, shared, base = [], [], 0
        for g in groups:
            own, prefix = deep_shallow_sort([side(r) for r in g])
            order += [base + i for i in own]
            shared += [-1, *prefix[1:]]
            base += len(g)
        number = np.empty((len(rows), len(a)), np.int64)
        number[order] = np.cumsum(np.array(shared)[:, None] < depth, axis=0)
        classes.append(number)
    i, k = np.nonzero((a <= (at - lo)[:, None]) & (a >= (at - hi)[:, None]))
    key = (classes[0][i, k] * (len(rows) + 1) + classes[1][i, k]) * len(a) + k
    order = np.lexsort((rank[i], key))
    i, k, key = i[order], k[order], key[order]
    first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(key)), 0))
    late = rank[i] > rank[i[first]]
    i, k = i[late], k[late]
    if not len(i):
        return np.empty(0, _SPAN)
    order = np.lexsort((k, i))
    i, k = i[order], k[order]
    begin = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (k[1:] != k[:-1] + 1)])
    end = np.r_[begin[1:], len(i)] - 1
    out = np.empty(len(begin), _SPAN)
    out["id"], out["th"] = ids[i[begin]], ths[i[begin]]
    out["start"], out["end"] = at[i[begin]] - k[end], at[i[begin]] - k[begin] + width
    return out


def sort_groups(width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(groups: list[list[tuple]]) -> pa.RecordBatch:
            found = shared_windows(groups, width)
            keys, own = np.unique(found[["id", "th"]], return_inverse=True)
            cut_ = [found[["start", "end"]][at].astype(_RANGE).tobytes() for _, at in _groups(own, len(keys))]
            return pa.record_batch([keys["id"].copy(), keys["th"].copy(), pa.array(cut_, pa.binary())], schema=schema)

        groups: list[list[tuple]] = []
        key, held = None, 0
        for batch in batches:
            for g, *rest in zip(*(batch.column(n).to_pylist() for n in range(7)), strict=True):
                if g != key:
                    if held >= TOGETHER:
                        yield out(groups)
                        groups, held = [], 0
                    groups.append([])
                    key = g
                groups[-1].append(tuple(rest))
                held += 1
        if groups:
            yield out(groups)

    return run


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 100) -> DataFrame:
    """For each document key with any: id, th, spans (list of byte-range arrays) to remove."""
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = docs.select(id_key(doc_id).alias("id"), text_key(text).alias("th"), F.col(text).alias("text"))
    scanned = keyed.where(F.octet_length("text") >= width).mapInArrow(lean(scan(width, GRAM, pieces_of(keyed, "text", BUCKET))), SCANNED)
    settled = scanned.groupBy("bucket").applyInArrow(settle(width, LARGE), SETTLED)
    settled = settled.groupBy("id", "th").agg(F.collect_list("spans").alias("spans"), F.collect_list("open").alias("open"))
    settled = table(settled, "settled")
    # shuffle_hash keeps the texts from being sorted; the build side has a few bytes for each anchor
    still = settled.where(F.size("open") > 0).select("id", "th", "open").hint("shuffle_hash")
    opened = table(keyed.join(still, ["id", "th"]).select("id", "th", "text", "open").mapInArrow(lean(contexts(width)), CONTEXTS), "contexts")
    schema = _schema("id long, th long, spans binary")
    small = opened.where(~F.col("large")).select("g1", "id", "th", "at", "lo", "hi", "context").repartition(n, "g1").sortWithinPartitions("g1")
    by_sort = small.mapInArrow(sort_groups(width, schema), "id long, th long, spans binary")
    windows = opened.where("large").select("g1", "g2", F.struct("id", "th", "at").alias("place"))
    first = windows.groupBy("g1", "g2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["g1", "g2"]).where("place > first").select("place.*")
    later = later.groupBy("id", "th").agg(F.sort_array(F.collect_list("at")).alias("at")).mapInArrow(_ranges(width, schema), "id long, th long, spans binary")
    at_once = opened.where(F.col("large").isNull()).select("id", "th", F.col("context").alias("spans"))
    more = by_sort.unionByName(later).unionByName(at_once).groupBy("id", "th").agg(F.collect_list("spans").alias("spans"))
    found = settled.where(F.size("spans") > 0).select("id", "th", "spans").unionByName(more)
    return found.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _ranges(width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for at in batch.column(2).to_pylist():
                x = np.empty(len(at), _RANGE)
                x["start"] = at
                x["end"] = x["start"] + width
                spans.append(x.tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(spans, pa.binary())], schema=schema)

    return run


def union(parts: list[bytes] | None) -> list[tuple[int, int]]:
    """Maximal runs of the byte ranges in ``parts``."""
    if not parts:
        return []
    x = np.frombuffer(b"".join(parts), _RANGE)
    x = x[np.argsort(x["start"], kind="stable")]
    reach = np.maximum.accumulate(x["end"])
    new = np.flatnonzero(np.r_[True, x["start"][1:] > reach[:-1]])
    return list(zip(x["start"][new].tolist(), reach[np.r_[new[1:], len(x)] - 1].tolist(), strict=True))


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, place = [], 0
    for a, b in spans:
        kept.append(data[place:a])
        place = b
    return b"".join((*kept, data[place:]))


def with_spans(docs: DataFrame, doc_id: str, text: str, width: int) -> tuple[DataFrame, str]:
    found = repeats(docs, doc_id, text, width)
    names = [fresh(docs, x) for x in ("_id", "_th", "_spans")]
    found = found.toDF(*names).hint("shuffle_hash")
    keyed = docs.withColumns({names[0]: id_key(doc_id), names[1]: text_key(text)})
    return keyed.join(found, names[:2], "left").drop(*names[:2]), names[2]


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    joined, spans = with_spans(docs.select(doc_id, text), doc_id, text, width)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, parts in zip(strings(batch, text), batch.column(spans).to_pylist(), strict=True):
                data, runs = x.encode(), union(parts)
                rows.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(cut(data, runs)).hexdigest()))
            yield pa.record_batch([batch.column(doc_id).cast(pa.int64()), *(list(x) for x in zip(*rows, strict=True))] if rows else [[]] * 5, schema=schema)

    return joined.select(doc_id, text, spans).mapInArrow(run, ddl)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 100) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; a character cut in two goes whole.  Texts without repeats are untouched."""
    joined, spans = with_spans(docs, doc_id, text, width)

    @F.pandas_udf("string")
    def kept(texts, parts):
        return texts.combine(parts, lambda x, p: x if x is None or p is None or not len(p) else cut(x.encode(), union(list(p))).decode("utf-8", "ignore"))

    return joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(kept(text, spans))).select(*docs.columns)
