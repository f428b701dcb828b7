import random

import numpy as np
import xxhash

from quern.llm import simhash
from quern.llm.simhash import fingerprint, keep_one, near_duplicates, trie_components


def slow_print(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def test_trie_self_join():
    rnd = random.Random(5)
    for _ in range(30):
        base = [rnd.getrandbits(64) for _ in range(4)]
        x = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(40)}
        x = np.array(sorted(x), np.uint64)
        root = trie_components(x, 16)
        pairs = {(i, j) for i in range(len(x)) for j in range(i) if x[i] >> np.uint64(48) == x[j] >> np.uint64(48) and int(x[i] ^ x[j]).bit_count() <= 3}
        want = list(range(len(x)))
        changed = True
        while changed:
            changed = False
            for i, j in pairs:
                m = min(want[i], want[j])
                if want[i] != m or want[j] != m:
                    want[i] = want[j] = m
                    changed = True
        assert root.tolist() == want


def rows():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdÉe") for _ in range(rnd.randint(1, 6)))
    out = []
    for _ in range(40):
        text = [word() for _ in range(rnd.choice([1, 2, 3, 5, 200, 400]))]
        for _ in range(rnd.randint(1, 5)):
            near = list(text)
            for _ in range(rnd.randint(0, 3)):
                near[rnd.randrange(len(near))] = word()
            out.append(rnd.choice([" ", "\n"]).join(near).title())
    out = [*out, None, "", " \t", "A b", "a B"]
    ids = list(range(len(out)))
    rnd.shuffle(ids)
    return [*zip(ids, out, strict=True), (None, out[0]), (5000, "same"), (5000, "same")]


def test_against_brute_force(spark):
    data = rows()
    prints = [slow_print(t or "") for _, t in data]
    assert prints == [fingerprint(t or "") for _, t in data]
    want = sorted((i is None, i, f"{p:016x}", c) for (i, _), p, c in zip(data, prints, slow_components([i for i, _ in data], prints), strict=True))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert sorted((r[0] is None, *r) for r in near_duplicates(docs).collect()) == want
    kept = keep_one(docs.selectExpr("doc_id", "text", "1 as _id")).collect()
    assert sorted(r.doc_id for r in kept) == sorted({w[3] for w in want})


def test_crowded_prefixes(spark, monkeypatch):
    """Prefixes dealt on by sub-blocks give the same components, whatever the partitions."""
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(3)]
    values = {b ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))}) for b in base for _ in range(60)}
    data = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(sorted(values))]
    want = slow_components([i for i, _ in data], sorted(values))
    prints = spark.createDataFrame([(i, 0, v) for i, v in data], "id long, th long, fp long")
    for crowd, parts in ((1 << 19, 4), (5, 1), (5, 13)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "TASK", 1 << 20 if parts != 13 else 60)
        got = {r.fp: r.component_id for r in simhash.components(prints.repartition(parts)).collect()}
        assert [got[v] for _, v in data] == want


def test_long_text():
    text = "ab cd ef " * 60_000
    assert fingerprint(text) == slow_print(text)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0 and keep_one(docs).count() == 0
