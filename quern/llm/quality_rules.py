"""Weak supervision of text quality: rules vote or abstain, and expectation-maximisation weighs them.

Each rule votes good (1), bad (-1) or abstains (0) on a text's measures.  The
corpus is summarised by the count of each vote pattern that occurs, 3 ** rules at
most, over all documents.  Expectation-maximisation estimates the share of good
texts and, for each rule, how often its vote is good on good texts and bad on bad
ones; an abstention says nothing.  Nothing ties a rule to its meaning but where the
rounds begin and a weak prior (``PRIOR``, three texts' worth): a rule whose bad
votes other rules don't share comes out as one that errs, and its vote alone
rejects nothing.  A text is kept if it passes the base rules and its posterior
probability of being good is ``THRESHOLD`` at least.

Words are maximal runs without ASCII white space.  Null text counts as empty:
it has no words, so the base rules reject it.  No key is used, so null or
repeated ids and clashing column names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import lean, sliced, strings, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_letters", "n_odd_words", "n_stutters", "n_plain")
THRESHOLD = 0.5
#: Where the rounds begin (share of good texts, right votes on good and on bad ones), and the prior's right and wrong votes of a rule.
BEGIN, PRIOR = (0.8, 0.9, 0.6), (2, 1)
#: Rounds end when no estimate moves by more, or after so many.
STILL, ROUNDS = 1e-9, 1000
WINDOW = 8
_ALL = np.arange(256)
_SYMBOL = np.isin(_ALL, list(b"#*$%&|<>"))
_MARK = np.isin(_ALL, list(b"!?"))
_UPPER = (_ALL >= 65) & (_ALL <= 90)
_LETTER = _UPPER | (_ALL >= 97) & (_ALL <= 122)
_SPACE = (_ALL >= 9) & (_ALL <= 13) | (_ALL == 32)
_STARTS = (_ALL & 0xC0) != 0x80
_PLAIN = _LETTER | (_ALL >= 48) & (_ALL <= 57) | (_ALL >= 0xC0)
#: Bytes by kind: white space, ASCII sign "!", letter, digit or beyond ASCII "a", control ".".
_KINDS = bytes(32 if _SPACE[i] else 97 if i >= 128 or _PLAIN[i] else 33 if 33 <= i <= 126 else 46 for i in range(256))


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more; ranks of windows of 1, 2, 4, ... words, so exact."""
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rank = np.fromiter(map(number.__getitem__, words), np.int64, n)
    kinds, span = len(number), 1
    while span < window:
        step = min(span, window - span)
        pair = rank[: len(rank) - step] * kinds + rank[step:]
        unique, rank = np.unique(pair, return_inverse=True)
        kinds, span = len(unique), span + step
        if kinds == len(rank):
            return 0
    found = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.bincount(found, minlength=n + 1) - np.bincount(found + window, minlength=n + 1)[: n + 1]
    return int(np.count_nonzero(np.cumsum(edge)))


def odd_words(data: bytes) -> int:
    """Words without letter or digit, or with two ASCII signs in a row."""
    kinds = data.translate(_KINDS)
    if b"!!" not in kinds and b" !" not in kinds and b" ." not in kinds and kinds[:1] not in (b"!", b"."):
        return 0
    return sum(b"!!" in w or b"a" not in w for w in kinds.split())


def measure(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()] if words else []
    letters = int(count[_LETTER].sum())
    return (
        len(words), int(count[_STARTS].sum() - count[_SPACE].sum()), int(count[_SYMBOL].sum()), len(lines) - len(set(lines)),
        repeat_words(words), len(lines), int(count[_MARK].sum()), int(count[_UPPER].sum()), letters,
        odd_words(data), sum(map(eq, words, islice(words, 1, None))), int(count[_PLAIN].sum()),
    )


def vote(value: Column, of: Column, good: float, bad: float) -> Column:
    """Good if value / of is ``good`` at most, bad if over ``bad``; no vote where ``of`` is zero."""
    return F.when(of == 0, 0).when(value <= good * of, 1).when(value > bad * of, -1).otherwise(0)


def rules() -> dict[str, Column]:
    c = F.col
    return {
        "length": F.when(c("n_words") >= 50, 1).when(c("n_words") < 10, -1).otherwise(0),
        "word_length": F.when(c("n_words") == 0, 0).when(c("word_chars").between(3 * c("n_words"), 12 * c("n_words")), 1).when((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 40 * c("n_words")), -1).otherwise(0),
        "symbols": vote(c("n_symbols"), c("n_words"), 0.1, 0.3),
        "repeats": vote(c("n_repeat_words"), c("n_words"), 0.1, 0.3),
        "lines": vote(c("n_dup_lines"), c("n_lines"), 0.2, 0.5),
        "marks": vote(c("n_marks"), c("n_words"), 0.2, 0.6),
        "capitals": vote(c("n_upper"), c("n_letters"), 0.3, 0.7),
        "odd_words": vote(c("n_odd_words"), c("n_words"), 0.1, 0.3),
        "stutters": vote(c("n_stutters"), c("n_words"), 0.1, 0.3),
        "signs": vote(c("word_chars") - c("n_plain"), c("word_chars"), 0.08, 0.15),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def pattern() -> Column:
    """The votes as one number in base 3."""
    out = F.lit(0)
    for v in rules().values():
        out = out * 3 + (v + 1)
    return out.cast("int")


def votes_of(code: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


@dataclass(frozen=True)
class Model:
    share: float
    good: list[float]
    bad: list[float]

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log odds of good before the votes, and what each rule's good and bad vote adds."""
        own = [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.good, self.bad, strict=True)]
        return math.log(self.share / (1 - self.share)), own


def fit(counts: dict[int, int], n: int) -> Model:
    """The estimates, from the counts of the vote patterns of ``n`` rules."""
    codes = sorted(counts)
    votes = np.array([votes_of(k, n) for k in codes], np.int8).reshape(-1, n)
    weight = np.array([counts[k] for k in codes], float)
    up, down = votes == 1, votes == -1
    right, wrong = PRIOR
    share, good, bad = BEGIN[0], np.full(n, BEGIN[1]), np.full(n, BEGIN[2])
    for _ in range(ROUNDS):
        odds = math.log(share / (1 - share)) + up @ np.log(good / (1 - bad)) + down @ np.log((1 - good) / bad)
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        a, b = p * weight, (1 - p) * weight
        before = np.r_[share, good, bad]
        share = (a.sum() + 1) / (weight.sum() + 2)
        good = (a @ up + right) / (a @ up + a @ down + right + wrong)
        bad = (b @ down + right) / (b @ up + b @ down + right + wrong)
        if np.abs(np.r_[share, good, bad] - before).max() <= STILL:
            break
    return Model(float(share), good.tolist(), bad.tolist())


def _measures(texts: list[str]) -> list[pa.Array]:
    rows = [measure(x) for x in texts]
    return [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(MEASURES)


def features(docs: DataFrame, doc_id: str | None = "doc_id", text: str = "text") -> DataFrame:
    """id (null without ``doc_id``) and the measures of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), *_measures(strings(batch, "text"))], ["id", *MEASURES])

    key = F.col(doc_id) if doc_id else F.lit(None)
    return docs.select(key.cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lean(run), "id long, " + ", ".join(f"{x} long" for x in MEASURES))


def learned(found: DataFrame) -> Model:
    """Fitted on the counts of all rows' vote patterns."""
    counts = {r[0]: r[1] for r in found.groupBy(pattern().alias("p")).count().collect()}  # a row for each pattern
    return fit(counts, len(rules()))


def posterior(model: Model) -> Column:
    odds, own = model.weights()
    out = F.lit(odds)
    for v, (up, down) in zip(rules().values(), own, strict=True):
        out = out + F.when(v == 1, up).when(v == -1, down).otherwise(0.0)
    return 1 / (1 + F.exp(-out))


def kept(model: Model) -> Column:
    return ~base_failed() & (posterior(model) >= THRESHOLD)


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and the posterior probability."""
    found = table(features(docs, doc_id, text), "features")
    model = learned(found)
    return found.select(F.col("id").alias("doc_id"), *MEASURES[:5], base_failed().alias("base_failed"), kept(model).alias("kept"), posterior(model).alias("quality"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept.  Measures are taken twice rather than moved: no shuffle but that of the counts."""
    model = learned(features(docs, None, text))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # so that no name clashes with a measure's
    names, own = plain.columns, f"c{docs.columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, own):
            yield pa.RecordBatch.from_arrays([*batch.columns, *_measures(strings(batch, own))], [*names, *MEASURES])

    schema = StructType([*plain.schema.fields, *(StructField(x, LongType()) for x in MEASURES)])
    return plain.mapInArrow(lean(run), schema).where(kept(model)).select(*names).toDF(*docs.columns)
