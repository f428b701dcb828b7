import hashlib
import os
import random

from quern.llm import suffix_dedup
from quern.llm.suffix_dedup import digests, remove_repeats
from quern.llm.suffix_sort import deep_shallow_sort


def brute(rows, width=100):
    seen, out = set(), []
    for _, i, text in sorted((i is not None, i or 0, t or "") for i, t in rows):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            w = data[p : p + width]
            if w in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(w)
        runs = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(4)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            s = rnd.choice(shared)
            a = rnd.randint(0, 60)
            parts.append(rnd.choice([prose(rnd.randint(1, 30)), s, s[a:], s[:-a or None], "ab" * rnd.randint(1, 200), "-" * rnd.randint(90, 260)]))
        rows.append((i, rnd.choice(["", " "]).join(parts)))
    base = prose(60).split(" ")
    for i in range(150, 260):  # near copies: grams with more contexts than are sorted together
        near = list(base)
        for _ in range(rnd.randint(0, 4)):
            near[rnd.randrange(len(near))] = word()
        rows.append((i, " ".join(near)))
    return [*rows, (300, rows[1][1]), (301, rows[160][1]), (302, None), (303, "x" * 99)]


def test_sort():
    rnd = random.Random(1)
    for _ in range(500):
        texts = [b"p" * rnd.choice([0, 20]) + bytes(rnd.randrange(3) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 20))]
        order, shared = deep_shallow_sort(texts)
        got = [texts[i] for i in order]
        assert got == sorted(texts)
        assert shared == [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(got, got[1:]))]


def test_against_brute_force(spark, monkeypatch):
    for seed, large, together in ((1, 256, 4096), (2, 5, 4096), (3, 60, 3)):
        monkeypatch.setattr(suffix_dedup, "LARGE", large)
        monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
        rows = corpus(seed)
        got = digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
        assert sorted(tuple(r)[1:] for r in got.collect()) == brute(rows)


def test_contexts_that_share_no_window():
    """Equal grams whose surroundings differ, alone and beside a group that shares some."""
    gram = b"g" * 32
    apart = [(1, 1, 40, 0, 8, b"a" * 40 + gram + b"b" * 36), (2, 2, 40, 0, 8, b"c" * 40 + gram + b"d" * 36)]
    alike = [(3, 3, 40, 0, 8, b"e" * 40 + gram + b"f" * 36), (4, 4, 41, 1, 9, b"e" * 40 + gram + b"f" * 35 + b"x")]
    assert len(suffix_dedup.shared_windows([apart], 100)) == 0
    found = suffix_dedup.shared_windows([apart, alike, [apart[0]]], 100)
    assert [tuple(map(int, x)) for x in found] == [(4, 4, 1, 108)]


def test_odd_input(spark):
    rnd = random.Random(3)
    long = "".join(rnd.choice("abc ") for _ in range(300_000))
    rows = [(None, "q" * 150, "a"), (None, None, None), (7, "q" * 150, "b"), (7, "q" * 150, "b"), (8, long, "c"), (9, long[5000:], "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string")
    got = {(r.doc_id, r._spans): r.text for r in remove_repeats(docs).collect()}
    assert got[None, "a"] == "q"  # its later windows repeat its first
    assert got[7, "b"] == "" and got[8, "c"] == long and got[9, "d"] == "" and got[None, None] is None
    assert remove_repeats(docs.limit(0)).count() == 0
