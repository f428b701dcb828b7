"""Byte-level BPE by DuckDB recursive queries in each partition.

A task gathers the distinct words that its texts have and that it doesn't know
yet; a word is a match of the pattern.  In the recursive query a row is a token of
a word with its place; each step joins neighbours with the merge table and
contracts each word's pairs of least rank, from the left; a word without such a
pair takes no further step.  The rows that are left, joined with the vocabulary and
put in order (one thread, so aggregates take them in it), are aggregated to the ids
and the bytes that they decode to; these must be the words' own.

One contraction after another, leftmost first, is the rule.  A step contracts all
of a word's pairs of the least rank at once only where that is the same: if no
merge that takes the new token has a lower rank (``alone`` in the merge table
marks the others, of which a step takes the leftmost), nothing of lower rank can
arise between them; and of pairs that overlap, in a run of equal tokens, every
second one goes, counted from the run's beginning.  The table of the recursion is
keyed by place, so it keeps a row for each byte whatever the number of steps.

Words of all lengths go this way.  The work is the word's length times its steps,
and the steps are at most the number of different merges that it needs.

Null text counts as empty.  No special tokens.  Repeated rows and null ids are rows like others.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, strings
from .token_counts import cut
from .vocabulary import Memory, default_path

#: Words remembered by a Python worker.
REMEMBERED = 350_000
#: Words, and bytes, of one recursive query (one word at least).
WORDS, BYTES = 20_000, 1 << 18

#: Words lie one after another with a place between them, so a token ends where its right neighbour begins and no pair spans two words.
CONTRACT = """
WITH RECURSIVE work(pos, step, word, fin, tok) USING KEY (pos) AS (
  SELECT pos, 0, word, fin, tok FROM begin_rows
  UNION (
  WITH paired AS (
    SELECT a.word, a.pos, a.fin, b.fin AS fin2, m.l = m.r AS twin, m.alone, m.rank
    FROM work a JOIN work b ON b.pos = a.fin JOIN merges m ON m.l = a.tok AND m.r = b.tok
  ), least AS (
    SELECT word, min(rank) AS rank FROM paired GROUP BY word
  ), tied AS (
    SELECT p.* FROM paired p JOIN least USING (word, rank)
  ), numbered AS (
    SELECT *, row_number() OVER w AS n, lag(fin) OVER w IS DISTINCT FROM pos AS new FROM tied WHERE twin AND NOT alone WINDOW w AS (PARTITION BY word ORDER BY pos)
  ), chosen AS (
    SELECT pos, fin, fin2, rank FROM tied WHERE NOT twin AND NOT alone
    UNION ALL SELECT pos, fin, fin2, rank FROM (SELECT *, n - max(CASE WHEN new THEN n END) OVER (PARTITION BY word ORDER BY pos) AS k FROM numbered) WHERE k % 2 = 0
    UNION ALL SELECT min(pos), arg_min(fin, pos), arg_min(fin2, pos), any_value(rank) FROM tied WHERE alone GROUP BY word
  ), edits AS (
    SELECT pos, fin2 AS fin, rank AS tok FROM chosen UNION ALL SELECT fin, fin, -1 FROM chosen
  )
  SELECT w.pos, w.step + 1, w.word, coalesce(e.fin, w.fin), coalesce(e.tok, w.tok)
  FROM work w JOIN least l ON l.word = w.word LEFT JOIN edits e ON e.pos = w.pos
  WHERE w.tok >= 0)
)
SELECT string_agg(tok::VARCHAR, ' ') AS ids, unhex(string_agg(hex, '')) AS decoded
FROM (SELECT word, pos, tok, hex FROM work JOIN vocabulary USING (tok) ORDER BY word, pos) GROUP BY word ORDER BY word
"""


class Encoder:
    _open: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        import duckdb

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks = self.ranks
        pairs = sorted((ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        left, right, rank = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
        first = np.full(1 + max(ranks.values()), np.iinfo(np.int32).max)  # the least rank of a merge that takes each token
        for side in (left, right):
            np.minimum.at(first, side, rank)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "900MB", "temp_directory": ""})
        self._table("merges", {"l": left, "r": right, "rank": rank, "alone": first[rank] <= rank})
        self._table("vocabulary", {"tok": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.known = Memory(REMEMBERED)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def contract(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The ids, in decimal, and the decoded bytes of each word."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)  # a word in the vocabulary is that token
        length = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.where(whole >= 0, 1, length)
        word = np.repeat(np.arange(len(words), dtype=np.int32), rows)
        pos = np.arange(len(word), dtype=np.int32) + word
        token = whole[word]
        token[token < 0] = self.single[np.frombuffer(b"".join(w for w, r in zip(words, whole.tolist(), strict=True) if r < 0), np.uint8)]
        self.db.register("begin_rows", pa.table({"word": word, "pos": pos, "fin": pos + np.int32(1), "tok": token}))
        found = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("begin_rows")
        decoded = found["decoded"].to_pylist()
        if decoded != words:
            raise ValueError("ids don't decode to their words")
        return list(zip(found["ids"].cast(pa.binary()).to_pylist(), decoded, strict=True))

    def learn(self, pieces: set[bytes]) -> None:
        new = sorted(self.known.unknown(pieces), key=len)  # words of like length take like numbers of steps
        begin = size = 0
        for i, w in enumerate(new):
            if i > begin and (i - begin == WORDS or size + len(w) > BYTES):
                self._learn(new[begin:i])
                begin, size = i, 0
            size += len(w)
        if new:
            self._learn(new[begin:])

    def _learn(self, words: list[bytes]) -> None:
        self.known.update(zip(words, self.contract(words), strict=True))


def distinct(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each piece's word, and the words.  Short pieces are compared eight bytes at a time; ``data`` has 8 spare bytes."""
    windows = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    number, words = np.empty(len(start), np.int64), []
    raw = data.tobytes()
    live, state, depth, base = np.arange(len(start)), np.zeros(len(start), np.int64), 0, 0
    while len(live):
        left = length[live] - depth
        take = np.minimum(left, 8)
        symbol, symbols = pd.factorize(windows[start[live] + depth] & masks[take])
        state, states = pd.factorize((state * len(symbols) + symbol) * 9 + take)
        done = left <= 8
        of, example = np.unique(state[done], return_index=True)
        ends = live[done]
        number[ends] = len(words) + np.searchsorted(of, state[done])
        at = ends[example]
        words += [raw[a : a + n] for a, n in zip(start[at].tolist(), length[at].tolist(), strict=True)]
        live, state, depth = live[~done], state[~done], depth + 8
        if 0 < len(live) < 16 or depth >= 1024:  # the last few long ones
            break
    seen: dict[bytes, int] = {}
    for i in live.tolist():
        w = raw[start[i] : start[i] + length[i]]
        if w not in seen:
            seen[w] = len(words)
            words.append(w)
        number[i] = seen[w]
    return number, words


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, one space between), decoded_sha256 of each row."""
    path = ranks or default_path("byte_bpe_50k.tiktoken")
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in sliced(batches, "text"):
            data, start, length, _, ends = cut(strings(batch, "text"))
            state, words = distinct(data, start, length)
            encoder.learn(set(words))
            ids_of, bytes_of = zip(*map(encoder.known.__getitem__, words), strict=True) if words else ((), ())
            rows, begin = [], 0
            for end in ends.tolist():
                own, begin = state[begin:end].tolist(), end
                ids = b" ".join(map(ids_of.__getitem__, own))
                decoded = b"".join(map(bytes_of.__getitem__, own))
                rows.append((ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pa.record_batch([batch.column("doc_id"), *(list(c) for c in zip(*rows, strict=True))], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ddl)
