import base64
import hashlib
import random

import numpy as np
import regex
import tiktoken

from quern.llm import byte_bpe
from public_tokenizers import PATTERN

from quern.llm.vocabulary import default_path

from .test_token_counts import every_code_point, texts


def encoding():
    with open(default_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip(spark):
    enc = encoding()
    data = [*texts(), "ab" * 3000 + " the" * 50, None, "y" * 200_000, "na " * 300_000]
    docs = spark.createDataFrame([*enumerate(data), (None, "a"), (3, None)], "doc_id long, text string").selectExpr("*", "1 as ids_sha256").repartition(3)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in [*enumerate(data), (None, "a"), (3, None)]:
        ids = enc.encode_ordinary(t or "")
        want.append((i is None, i or 0, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = [(r[0] is None, r[0] or 0, *r[1:]) for r in byte_bpe.round_trip(docs).collect()]
    assert sorted(got) == sorted(want)
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0


def test_every_code_point_and_long_words():
    """Words against the library, one step after another or several at once: random ones, runs, and one of 6,000 letters."""
    enc, own = encoding(), byte_bpe.Encoder.of(default_path("byte_bpe_50k.tiktoken"))
    rnd = random.Random(5)
    data = [c for t in every_code_point()[::8] for c in regex.findall(PATTERN, t)]
    data += ["".join(rnd.choice(letters) for _ in range(n)) for letters in ("ab", "a", "etaoin", "世界和", "-=") for n in (1, 2, 3, 7, 31, 500)]
    data += ["".join(rnd.choice("etaoinshrdlu") for _ in range(6000))]
    words = sorted({x.encode() for x in data})
    own.learn(set(words))
    for w in words:
        assert own.known[w] == (" ".join(map(str, enc._core_bpe.encode_single_piece(w))).encode(), w)


def test_pieces_are_the_patterns():
    enc = encoding()
    for t in every_code_point():
        data, start, length, _, _ = byte_bpe.cut([t])
        raw = data.tobytes()
        assert sum(len(enc._core_bpe.encode_single_piece(raw[a : a + n])) for a, n in zip(start.tolist(), length.tolist())) == len(enc.encode_ordinary(t))


def test_distinct():
    rnd = random.Random(6)
    pieces = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.choice([1, 2, 8, 9, 16, 17, 40, 3000]))) for _ in range(400)]
    data = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
    length = np.array([len(x) for x in pieces])
    number, words = byte_bpe.distinct(data, np.cumsum(length) - length, length)
    assert [words[i] for i in number.tolist()] == pieces and len(words) == len(set(pieces))
