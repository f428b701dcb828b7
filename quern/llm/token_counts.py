"""Token counts by compiled finite-state transducers.

The pre-tokenizer's pattern is a deterministic transducer over 12 classes of
characters and 12 states that emits, with a delay of one character at most,
where a piece starts.  A batch of texts is one string over these classes, cut
into lanes.  All lanes run at once from every state; the resulting state maps
compose by a parallel prefix scan, which gives each lane its true first state,
and a second run emits the starts.

The merges are a second transducer, over bytes (``merge_automaton``), whose
transitions carry the change in the count of tokens.  It begins anew at each piece,
so all pieces run at once, and a piece's count is the sum along its path whatever
its length; a text's count is the difference of a prefix sum over the pieces.  No
tokenizer library takes part.

Null text counts as empty.  The special token's string in a text is that token,
as the library takes it by default.  Repeated rows and null ids are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, sliced, strings
from .merge_automaton import MergeAutomaton
from .vocabulary import SPECIAL, Classes, default_path

# classes
SPACE, OTHER_SPACE, LETTER, NUMBER, OTHER, APOSTROPHE, STMD, R, V, L_, E_, END = range(12)
# states: what the open piece is
NONE, ONE_SPACE, ONE_OTHER, RUN_SPACE, RUN_OTHER, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
#: Emissions: a piece starts here; at the character before.
HERE, BEFORE = 1, 2
WORDS = (LETTER, STMD, R, V, L_, E_)
#: Characters after which lanes are looked at for having come to one state.
SETTLING = 64
#: Bytes of text read at a time.
SLICE = 2 << 20


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission for each state and class."""
    go, emit = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)

    def begin(state: int, extra: int = 0, attach: bool = False) -> None:
        """What follows a finished piece; ``attach``: a space before the character belongs to its piece."""
        for c in range(12):
            if c == END:
                go[state, c] = NONE
                continue
            go[state, c] = LETTERS if c in WORDS else {SPACE: ONE_SPACE, OTHER_SPACE: ONE_OTHER, NUMBER: NUMBERS, OTHER: OTHERS, APOSTROPHE: OTHERS if attach else QUOTE}[c]
            emit[state, c] = extra | (0 if attach else HERE)

    begin(NONE)
    begin(ONE_SPACE, attach=True)
    begin(ONE_OTHER)
    begin(RUN_SPACE, BEFORE, attach=True)
    begin(RUN_OTHER, BEFORE)
    for s in (ONE_SPACE, ONE_OTHER, RUN_SPACE, RUN_OTHER):
        go[s, SPACE], go[s, OTHER_SPACE] = RUN_SPACE, RUN_OTHER
        emit[s, [SPACE, OTHER_SPACE]] = 0
    begin(LETTERS)
    emit[LETTERS, WORDS] = 0
    begin(NUMBERS)
    emit[NUMBERS, NUMBER] = 0
    begin(OTHERS)
    begin(QUOTE)
    for s in (OTHERS, QUOTE):
        go[s, [OTHER, APOSTROPHE]] = OTHERS
        emit[s, [OTHER, APOSTROPHE]] = 0
    for c, to in ((STMD, NONE), (R, QUOTE_R), (V, QUOTE_V), (L_, QUOTE_L)):
        go[QUOTE, c], emit[QUOTE, c] = to, 0
    for s, last in ((QUOTE_R, E_), (QUOTE_V, E_), (QUOTE_L, L_)):
        begin(s, BEFORE)
        emit[s, END] = BEFORE
        emit[s, WORDS] = BEFORE
        go[s, last], emit[s, last] = NONE, 0
    return go, emit


GO, EMIT = transducer()
_table: np.ndarray | None = None


def class_table() -> np.ndarray:
    global _table
    if _table is None:
        out = np.array([LETTER, NUMBER, OTHER_SPACE, OTHER], np.uint8)[Classes.get().kind]
        out[ord(" ")], out[ord("'")] = SPACE, APOSTROPHE
        for k, letters in ((STMD, "stmd"), (R, "r"), (V, "v"), (L_, "l"), (E_, "e")):
            out[[ord(x) for x in letters]] = k
        out[0xD800:0xE000] = END  # stand for ends of texts and for special tokens
        _table = out
    return _table


def lane_starts(maps: np.ndarray) -> np.ndarray:
    """Each lane's first state, from all lanes' state maps, by an inclusive scan of map composition."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return np.r_[NONE, maps[:-1, NONE]].astype(np.intp)


def piece_starts(classes: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """Flags: a piece starts at this character."""
    n = len(classes)
    lanes = max(1, min(lanes, n // 64))
    width = -(-n // lanes)
    lanes = -(-n // width)
    padded = np.full(lanes * width, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(lanes, width).T)
    scaled, emit = (GO.astype(np.intp) * 12).ravel(), EMIT.ravel()
    maps = np.tile(np.arange(12, dtype=np.intp) * 12, (lanes, 1))
    for x in columns[:SETTLING]:
        maps += x[:, None]
        maps = scaled.take(maps)
    one = (maps == maps[:, :1]).all(1)  # lanes that end in one state wherever they began: a vector goes on for them
    if width > SETTLING and one.any():
        ends, rest = maps[one, 0], maps[~one]
        for x in columns[SETTLING:]:
            ends += x[one]
            ends = scaled.take(ends)
            if len(rest):
                rest += x[~one, None]
                rest = scaled.take(rest)
        maps[one], maps[~one] = ends[:, None], rest
    else:
        for x in columns[SETTLING:]:
            maps += x[:, None]
            maps = scaled.take(maps)
    state = lane_starts((maps // 12).astype(np.uint8)) * 12
    out = np.empty((width, lanes), np.uint8)
    for i, x in enumerate(columns):
        state += x
        emit.take(state, out=out[i])
        state = scaled.take(state)
    flags = out.T.ravel()[:n]
    starts = (flags & HERE).astype(bool)
    starts[:-1] |= (flags[1:] & BEFORE).astype(bool)
    return starts & (classes != END)


def cut(texts: list[str], special: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with 8 spare ones, each piece's place and length, whether it is special, and how many pieces there are up to each text's end.

    ``special``: the special token's string is a piece of its own.
    """
    joined = "".join([f"{x.replace(SPECIAL, chr(0xD801)) if special and SPECIAL in x else x}\ud800" for x in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass") + bytes(8), np.uint8)
    classes = class_table()[points]
    starts = piece_starts(classes) if len(points) else np.empty(0, bool)
    if special:
        starts |= points == 0xD801
    edges, ends = np.flatnonzero(starts | (classes == END)), np.flatnonzero(points == 0xD800)
    place = np.flatnonzero((data & 0xC0) != 0x80)[edges]  # where the characters begin
    which = np.flatnonzero(starts[edges])
    marks = points[edges[which]] == 0xD801
    start, length = place[which], place[np.minimum(which + 1, len(place) - 1)] - place[which]
    return data, start, length, marks, np.searchsorted(edges[which], ends)


def _special(path: str) -> tuple[MergeAutomaton, int | None]:
    automaton = MergeAutomaton.of(path)
    if set(automaton.added) - {SPECIAL}:
        raise ValueError(f"special tokens other than {SPECIAL}")
    return automaton, automaton.added.get(SPECIAL)


def _up_to(totals: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Prefix sums over the pieces, at the beginning of the first text and at each one's end."""
    return np.r_[0, np.cumsum(totals)][np.r_[0, ends]]


def count(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    automaton, special = _special(path)
    data, start, length, marks, ends = cut(texts, special is not None)
    totals = np.ones(len(start), np.int64)
    totals[~marks] = automaton.run(data, start[~marks], length[~marks])
    return np.diff(_up_to(totals, ends))


def ids(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit numbers."""
    automaton, special = _special(path)
    data, start, length, marks, ends = cut(texts, special is not None)
    totals = np.ones(len(start), np.int64)
    totals[~marks], flat = automaton.ids(data, start[~marks], length[~marks])
    if marks.any():
        whole = np.full(int(totals.sum()), special, "<u4")
        whole[np.repeat(~marks, totals)] = flat
        flat = whole
    out, cuts = flat.tobytes(), (4 * _up_to(totals, ends)).tolist()
    return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    path = tokenizer or default_path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            got = count(strings(batch, "text"), path)
            size = pc.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            yield pa.record_batch([batch.column("doc_id"), size, got, got > limit], schema=schema)
        MergeAutomaton.of(path).rest()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
