"""Copies of rejected rows, and rows without a key."""

import os
import random

from pyspark.sql import functions as F

from quern.functions import similarity as S
from quern.operators import dedup as D
from quern.plans import catalog


def sequential(rows, least):
    accepted = []
    for i, t in rows:
        if not any(t and s and len(set(t) & s) >= least * len(set(t) | s) for _, s in accepted):
            accepted.append((i, set(t)))
    return [i for i, _ in accepted]


def test_copies_of_rejected_rows_go(spark):
    rnd = random.Random(1)
    rows = [(0, list("abcd")), (1, list("abcde")), (2, list("edcba")), (3, list("abcde"))]
    rows += [(i, [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 7))]) for i in range(4, 600)]
    frame = spark.createDataFrame(rows, "id long, t array<string>")
    kept = D.greedy(frame, D.token_pairs(frame, "id", "t", 0.75), "id")
    assert sorted(r.id for r in kept.collect()) == sequential(rows, 0.75)


def test_cascade_keeps_null_texts(spark, tmp_path):
    rows = [(1, None), (2, "red fox"), (3, None), (4, "red fox")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["duplicate_cascade"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, None), (2, None), (3, "title"), (4, "title")]


def test_composite_pairs(spark):
    """Every later row of a pair, against all pairs; copies, equal sets under other titles, nulls and empty ones included."""
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["red pie", "red pies", "blue pie", "", None]), [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 7))]) for i in range(150)]
    rows += [(200, "red pie", list("abc")), (201, "red pie", list("cba")), (202, "red pies", list("abc")), (203, "other", list("abc"))]

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    def score(a, b):
        if a[1] is None or b[1] is None:
            return 0
        longest, s, t = max(len(a[1]), len(b[1])), set(a[2]), set(b[2])
        title = 1 - levenshtein(a[1], b[1]) / longest if longest else 0
        return 0.6 * title + 0.4 * (len(s & t) / len(s | t) if s | t else 0)

    want = {b[0] for b in rows for a in rows if a[0] < b[0] and score(a, b) >= 0.85 - 1e-12}
    frame = spark.createDataFrame(rows, "id long, k string, t array<string>").repartition(3)
    assert {r.b for r in D.composite_pairs(frame, "id", "k", "t").collect()} == want


def test_token_pairs_of_long_sets(spark):
    rnd = random.Random(6)
    base = [[f"w{rnd.randrange(400)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(90):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 40)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(400)}"
        if not any(set(words) == set(t) for _, t in rows):
            rows.append((i, words))
    want = {(a, b) for a, s in rows for b, t in rows if a < b and len(set(s) & set(t)) >= 0.75 * len(set(s) | set(t))}
    got = D.token_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", 0.75)
    assert want and {(r.a, r.b) for r in got.collect()} == want


def test_token_pairs_leave_whole_sets_out(spark, monkeypatch):
    """Of long sets that are like no other, only what finds pairs is written, and tables go when they are read."""
    sizes, tables = [], []

    def stored(df, kept=D.stored):
        out = kept(df)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()))
        tables.append(out.inputFiles())
        return out

    monkeypatch.setattr(D, "stored", stored)
    rnd = random.Random(9)
    rows = [(i, [f"{rnd.getrandbits(120):030x}" for _ in range(200)]) for i in range(300)]
    rows += [(300, rows[0][1][:199] + ["new"]), (301, list(rows[1][1]))]
    pairs = D.token_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", 0.75)
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 300), (1, 301)}
    assert sum(sizes) < sum(len(x) for _, t in rows for x in t) / 3
    assert sum(os.path.exists(f.removeprefix("file://")) for files in tables for f in files) <= sum(len(files) for files in tables[-2:])


def test_cascade_seeks_pairs_once(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(D, "token_pairs", lambda *a, kept=D.token_pairs: calls.append(a[-1]) or kept(*a))
    rows = [(1, "red fox\na b c d e f"), (2, "red dog\na b c d e f"), (3, "blue hat\nx y z"), (4, "red foxs\na b c d e g")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["duplicate_cascade"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, None), (2, "ingredients"), (3, None), (4, "title")] and len(calls) == 1


def test_token_pairs_of_long_unlike_sets(spark, monkeypatch):
    """Long sets that only share some tokens don't become pairs; large groups of near copies keep all theirs."""
    found = []

    def stored(df, kept=D.stored):
        out = kept(df)
        if out.columns == ["a", "b"]:
            found.append(out.count())
        return out

    monkeypatch.setattr(D, "stored", stored)
    rnd = random.Random(3)
    rows = [(i, [f"w{x}" for x in rnd.sample(range(12000), 1000 + 10 * i)]) for i in range(40)]
    rows += [(100 + i, [*rows[0][1][: 1000 - 7 * i], *(f"n{i}.{j}" for j in range(7 * i))]) for i in range(1, 30)]
    near = [f"c{x}" for x in range(40)]
    rows += [(200 + i, [x for j, x in enumerate(near) if j not in (i % 20, i // 20)]) for i in range(300)]
    sets = {i: frozenset(t) for i, t in rows}
    first = {}
    for i, t in sets.items():
        first.setdefault(t, i)
    firsts = [(i, t) for t, i in first.items()]
    want = {(a, b) for a, s in firsts for b, t in firsts if a < b and len(s & t) >= 0.75 * len(s | t)}
    copies = {(first[t], i) for i, t in sets.items() if first[t] != i}
    frame = spark.createDataFrame(rows, "id long, t array<string>").repartition(3)
    got = [(r.a, r.b) for r in D.token_pairs(frame, "id", "t", 0.75).collect()]
    assert len(got) == len(set(got)) and set(got) == want | copies
    assert sum(found) < len(want) + 200


def test_token_pairs_at_low_similarity(spark, monkeypatch):
    """Unlike sets don't become pairs where 0.625 is enough either."""
    found = []

    def stored(df, kept=D.stored):
        out = kept(df)
        if out.columns == ["a", "b"]:
            found.append(out.count())
        return out

    monkeypatch.setattr(D, "stored", stored)
    rnd = random.Random(4)
    rows = [(i, [f"w{x}" for x in rnd.sample(range(2000), 128)]) for i in range(300)]
    rows += [(300 + i, [*t[:100], *(f"n{i}.{j}" for j in range(28))]) for i, t in rows[:20]]
    got = D.token_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", 0.625)
    assert {(r.a, r.b) for r in got.collect()} == {(i, 300 + i) for i in range(20)}
    assert sum(found) < 100


def test_token_pairs_in_rounds(spark, monkeypatch):
    """Rounds find each pair once, and the hashes of all tokens are off the disk by then."""
    tables, found = {}, []

    def stored(df, kept=D.stored):
        out = kept(df)
        if out.columns == ["a", "b"]:
            found.append({(r.a, r.b) for r in out.collect()})
            assert not any(os.path.exists(f) for f in tables["h"])
        tables[out.columns[-1]] = [f.removeprefix("file://") for f in out.inputFiles()]
        return out

    monkeypatch.setattr(D, "stored", stored)
    monkeypatch.setattr(D, "ROUND_TOKENS", 1)
    rnd = random.Random(5)
    rows = [(i, list({rnd.choice("abcdefghijkl") for _ in range(rnd.randint(0, 9))})) for i in range(200)]
    sets = {i: frozenset(t) for i, t in rows if t}
    first = {}
    for i, t in sets.items():
        first.setdefault(t, i)
    firsts = [(i, t) for t, i in first.items()]
    want = {(a, b) for a, s in firsts for b, t in firsts if a < b and len(s & t) >= 0.625 * len(s | t)}
    got = [(r.a, r.b) for r in D.token_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", 0.625).collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(first[t], i) for i, t in sets.items() if first[t] != i}
    assert len(found) == D.ROUNDS and sum(map(len, found)) == len(set().union(*found)) and sum(map(bool, found)) > 1


def test_similarity_from(spark):
    """Bounded distances give the plain similarity wherever it is enough."""
    rnd = random.Random(7)
    rows = [("", "", 0.5), (None, "a", 0.5), ("a" * 20000, "a" * 20000 + "b", 0.9)]
    for _ in range(400):
        a = [rnd.choice("abcd ") for _ in range(rnd.choice([1, 5, 60, 400]))]
        b = list(a)
        for _ in range(rnd.choice([0, 1, 17, 40, 200])):
            b[rnd.randrange(len(b))] = rnd.choice(["", "x", "yz"])
        rows.append(("".join(a), "".join(b), rnd.choice([-0.2, 0.0, 0.5, 0.75, 0.9, 1.0, 1.1])))
    frame = spark.createDataFrame(rows, "a string, b string, least double")
    for r in frame.select("least", S.similarity(F.col("a"), F.col("b")).alias("s"), S.similarity_from(F.col("a"), F.col("b"), F.col("least")).alias("t")).collect():
        assert r.t == r.s or r.s < r.least and r.t is None


def test_cascade_scores_what_items_leave(spark, tmp_path, monkeypatch):
    """Links to rows that the items decide have no titles compared; the other rows keep theirs."""
    given = []
    monkeypatch.setattr(D, "composite_pairs", lambda *a, kept=D.composite_pairs, links: given.extend(map(tuple, links.select("a", "b").collect())) or kept(*a, links=links))
    one = "one very long and winding title"
    rows = [(1, f"{one}\na b c d e f g h i j k l"), (2, f"hat {one[4:]}\na b c d e f g h i j k l"), (3, f"{one}d\na b c d e f g h i j x y"), (4, f"{one}\nq r s")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(map(tuple, catalog.queries()["duplicate_cascade"](spark, str(tmp_path)).collect()))
    sets = {i: set(t.lower().split()) for i, t in rows}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    items = {b for (a, b), x in like.items() if x >= 0.75}
    assert set(given) == {(a, b) for (a, b), x in like.items() if x >= 0.625 and b not in items}
    assert items == {2} and got == {1: None, 2: "ingredients", 3: "composite", 4: "title"}
