import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from quern.llm import packing
from quern.llm.vocabulary import default_path


def check(rows, docs):
    tok = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    want = []
    for i, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > first else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is None, *r[1:], r[0] or 0)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    return len(bins), sum(r.length for r in rows)


def documents():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdéf 1'!\n") for _ in range(rnd.randint(1, 8)))
    out = [(i, " ".join(word() for _ in range(int(rnd.lognormvariate(4.5, 1.2))))) for i in range(400)]
    return [*out, (None, None), (5, ""), (5, ""), (6, "x" * 50_000), (7, "a<|endoftext|> b  <|endoftext|>"), (8, "it's we'll 'tis ''s \r\n\n x")]


def test_pack(spark):
    docs = documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bins, tokens = check(packing.pack(frame).collect(), docs)
    assert bins <= 1.03 * tokens / 1024 + 2
    assert packing.pack(frame.limit(0)).count() == 0


def test_rounds():
    rnd = np.random.default_rng(3)
    histogram = np.bincount(rnd.integers(1, 1024, 5000), minlength=1024)
    layers = packing.plan(histogram, 1024, limit=700)
    assert len(layers) > 1
    length = np.repeat(np.arange(1024), histogram)
    rank = np.concatenate([np.arange(n) for n in histogram])
    sequence, offset = packing.locate(layers, length, rank)
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    new = np.r_[True, s[1:] != s[:-1]]
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + n)[:-1][~new[1:]]).all() and (o + n <= 1024).all()
