import hashlib
import random
import re
from collections import defaultdict

from quern.llm import line_templates as lt


def brute(rows, min_docs=5):
    docs = {}
    for i, t in rows:
        docs[(i is not None, i or 0, t or "")] = [(n, re.split(r"[\t-\r ]+", x.strip(" \t\n\r\x0b\x0c"))) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]

    masked = lambda tokens: tuple("<*>" if re.search("[0-9]", t) else t for t in tokens)
    leaf_of = lambda tokens: (len(tokens), *masked(tokens)[:2])
    in_leaf = defaultdict(set)
    for d, lines in docs.items():
        for _, tokens in lines:
            in_leaf[leaf_of(tokens)].add((d, tuple(tokens)))
    live = {leaf for leaf, lines in in_leaf.items() if len({d for d, _ in lines}) >= min_docs}
    def runs(tokens):
        m, g = masked(tokens), 3 * len(tokens) // 10 + 1
        return [(leaf_of(tokens), j, m[len(m) * j // g : len(m) * (j + 1) // g]) for j in range(g)]

    often = defaultdict(int)
    for leaf in live:
        for _, tokens in in_leaf[leaf]:
            for run in runs(tokens):
                often[run] += 1
    candidate = lambda tokens: len(tokens) >= 4 and any(often[r] >= min_docs for r in runs(tokens))
    stands, total = defaultdict(int), defaultdict(int)
    for leaf in live:
        for _, tokens in in_leaf[leaf]:
            if candidate(tokens):
                total[leaf] += 1
                m = masked(tokens)
                for p, x in enumerate(m):
                    stands[leaf, p, x] += 1
                    stands[leaf, p, m[p : p + 2]] += 1

    def template(tokens):
        leaf, m = leaf_of(tokens), masked(tokens)
        if not candidate(tokens):
            return leaf, tuple(tokens)

        def constant(p):
            own = stands[leaf, p, m[p]]
            if m[p] == "<*>" or own < min_docs:
                return False
            near = [(stands[leaf, p + k, m[p + k]], stands[leaf, p + min(k, 0), m[p + min(k, 0) : p + min(k, 0) + 2]]) for k in (-1, 1) if 0 <= p + k < len(m)]
            return 2 * own >= total[leaf] or any(n >= min_docs and 2 * both >= n for n, both in near)

        fixed = tuple((p, x) for p, x in enumerate(m) if constant(p))
        enough = len(fixed) >= 3 and 10 * len(fixed) >= 7 * sum(x != "<*>" for x in m)
        return (leaf, "template", fixed, tuple(x == "<*>" for x in m)) if enough else (leaf, tuple(tokens))

    where = defaultdict(set)
    for d, lines in docs.items():
        for _, tokens in lines:
            where[template(tokens)].add(d)
    order = lambda d: (d[0], d[1], keys[d])
    keys = {d: d[2] for d in docs}
    out = []
    for i, t in rows:
        d = (i is not None, i or 0, t or "")
        gone = {n for n, tokens in docs[d] if len(where[template(tokens)]) >= min_docs and min(where[template(tokens)], key=order) != d}
        left = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone)
        out.append((i is None, i or 0, (t or "").count("\n") + 1, len(gone), len(left), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def corpus():
    rnd = random.Random(11)
    word = lambda: rnd.choice(["the", "of", "and", "été", "to"]) if rnd.random() < 0.3 else "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 5)))
    line = lambda n: " ".join(word() for _ in range(n))
    fixed = [line(4), line(12), "All rights reserved.", "Page {} of 9 here", "Copyright {} by {} and all the others", "Posted by {} in the long list of very many things that we {} do not read at all"]
    rows = []
    for i in range(200):
        lines = [line(rnd.randint(1, 20)) for _ in range(rnd.randint(0, 4))]
        lines += [rnd.choice(fixed).replace("{}", rnd.choice([word(), str(rnd.randint(1, 999))])) for _ in range(rnd.randint(0, 3))]
        rnd.shuffle(lines)
        rows.append((i, rnd.choice(["\n", "\n\n"]).join(lines)))
    copies = "\n".join(line(15) for _ in range(4))
    rows += [(i, copies) for i in range(300, 310)] + [(i, copies.replace("the", f"x{i}")) for i in range(310, 318)]
    return [*rows, (None, None), (None, "All rights reserved."), (400, ""), (401, copies), (401, copies), (402, "y " * 5000)]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as _lines").repartition(4)
    got = [(r[0] is None, r[0] or 0, *r[1:]) for r in lt.digests(docs).collect()]
    assert sorted(got) == brute(rows)
    kept = lt.drop_recurring(docs)
    assert kept.columns == docs.columns
    shas = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in kept.collect())
    assert shas == sorted(r[-1] for r in got)
    assert lt.digests(docs.limit(0)).count() == 0


def lost(spark, lines):
    """Documents of one line each: how many lines go."""
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return sum(r.n_dropped for r in lt.digests(docs).collect())


def test_slots_with_many_values(spark):
    """A slot's values stay variable at every size, in short lines and in long ones."""
    rnd = random.Random(4)
    for n, values in ((50, 50), (200, 20), (1000, 40)):
        names = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(values)]
        short = [f"This article was posted by {rnd.choice(names)} in the {rnd.choice(names)} section of our community forum" for _ in range(n)]
        long = [f"Please note that {rnd.choice(names)} and all of the others who {rnd.choice(names)} these many pages do not answer for {rnd.choice(names)}" for _ in range(n)]
        assert lost(spark, short) == n - 1 and lost(spark, long) == n - 1


def test_numbers_alone_make_no_template(spark):
    rnd = random.Random(5)
    rows = sorted({f"{rnd.randint(1, 10**6)} {rnd.randint(1, 10**6)} {rnd.randint(1, 10**6)} {rnd.randint(1, 10**6)}" for _ in range(100)})
    totals = [f"Total: {n}" for n in range(100)]
    assert lost(spark, rows + totals) == 0
    assert lost(spark, [f"Page {n} of 100 here" for n in range(100)]) == 99


def test_very_long_line(spark):
    text = "word " * 400_000
    assert lost(spark, [text + "a"] * 6) == 5
