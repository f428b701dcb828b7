import math
import random
import re

from quern.llm import quality_rules as q


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    signs = r"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
    odd = [w for w in words if not any(c.isascii() and c.isalnum() or ord(c) > 127 for c in w) or any(a in signs and b in signs for a, b in zip(w, w[1:]))]
    plain = [c for c in text if c.isascii() and c.isalnum() or ord(c) > 127]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), len(lines), len(re.findall("[!?]", text)),
        len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text)), len(odd), sum(a == b for a, b in zip(words, words[1:])), len(plain),
    )


def slow_votes(m):
    words, chars, symbols, dup, repeat, lines, marks, upper, letters, odd, stutter, plain = m

    def share(part, of, good, bad):
        return 0 if not of else 1 if part <= good * of else -1 if part > bad * of else 0

    return (
        1 if words >= 50 else -1 if words < 10 else 0,
        0 if not words else 1 if 3 * words <= chars <= 12 * words else -1 if chars < 2 * words or chars > 40 * words else 0,
        share(symbols, words, 0.1, 0.3), share(repeat, words, 0.1, 0.3), share(dup, lines, 0.2, 0.5), share(marks, words, 0.2, 0.6),
        share(upper, letters, 0.3, 0.7), share(odd, words, 0.1, 0.3), share(stutter, words, 0.1, 0.3), share(chars - plain, chars, 0.08, 0.15),
    )


def plain_quality(texts):
    """kept and the posterior of each text: expectation-maximisation text by text, without patterns."""
    measures = [slow(t or "") for t in texts]
    votes = [slow_votes(m) for m in measures]
    n = len(votes[0]) if votes else 0
    share, good, bad = 0.8, [0.9] * n, [0.6] * n
    odds = lambda v: share / (1 - share) * math.prod(g / (1 - b) if x == 1 else (1 - g) / b if x == -1 else 1 for x, g, b in zip(v, good, bad))
    for _ in range(300):
        p = [1 - 1 / (1 + odds(v)) for v in votes]
        share = (sum(p) + 1) / (len(p) + 2)
        count = lambda j, x, w: sum(a for a, v in zip(w, votes) if v[j] == x)
        q = [1 - x for x in p]
        good = [(count(j, 1, p) + 2) / (count(j, 1, p) + count(j, -1, p) + 3) for j in range(n)]
        bad = [(count(j, -1, q) + 2) / (count(j, 1, q) + count(j, -1, q) + 3) for j in range(n)]
    p = [1 - 1 / (1 + odds(v)) for v in votes]
    return [(x >= 0.5 and m[0] >= 20 and 100 * m[4] <= 30 * m[0], x) for x, m in zip(p, measures)]


def texts():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefé 世") for _ in range(rnd.randint(1, 9)))
    out = ["", " \n\n ", "a", "x " * 200, "a b\na b\n\na b\r\nc"]
    for _ in range(60):
        words = [word() for _ in range(rnd.choice([5, 19, 20, 60, 150]))]
        out.append(rnd.choice([" ", "\n", "\x0b"]).join(words))
        out.append(" ".join(words + words[: rnd.randint(0, 40)]))
    return out


def test_measures():
    for t in texts():
        assert q.measure(t) == slow(t)
    long = "word and! " * 300_000 + "-" * 1_000_000 + "x" * 1_000_000
    m = q.measure(long)
    assert m[0] == 600_001 and m[4] == 600_000 and m[9] == 1 and m[10] == 0


def corpus():
    rnd = random.Random(1)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    out = [prose(rnd.randint(25, 90)) for _ in range(150)]
    out += [" | ".join(prose(60).split()) for _ in range(10)] + [prose(70).upper().replace(" ", "!! ") for _ in range(12)] + [prose(70).replace(" ", "$$$ ") for _ in range(12)]
    out += [(prose(6) + " ") * 20 for _ in range(8)] + [" ".join(w for w in prose(12).split() for _ in range(6)) for _ in range(3)]
    return [*out, prose(80).upper(), "one\n" * 3 + prose(70).replace(" ", "? "), None, "", "short"]


def test_expectation_maximisation(spark):
    """Estimates agree with a plain version; bad votes that no other rule shares don't reject."""
    texts = corpus()
    want = plain_quality(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in q.scores(docs).collect()}
    for i, (kept, p) in enumerate(want):
        assert got[i].kept == kept and abs(got[i].quality - p) < 1e-6
    votes = [slow_votes(slow(t or "")) for t in texts]
    assert any(kept and -1 in v for v, (kept, _) in zip(votes, want))
    assert all(kept for kept, _ in want[:150]) and not any(kept for kept, _ in want[160:184])


def test_any_column_names(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(corpus())], "doc_id long, text string, `a.b` int, n_words int")
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in q.scores(docs).collect() if r.kept}


def test_queries(spark):
    rnd = random.Random(1)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    good = [prose(rnd.randint(25, 300)) for _ in range(300)]
    junk = [" | ".join(prose(60).split()) for _ in range(20)] + [prose(80).upper().replace(" ", "!! ") for _ in range(20)] + [prose(80).replace(" ", "$$$ ") for _ in range(20)]
    rows = [*((i, t) for i, t in enumerate(good + junk)), (None, None), (5, "short"), (5, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in q.scores(docs).collect() if r.doc_id is not None}
    assert all(got[i].kept for i in range(6, 300)) and not any(got[i].kept for i in range(300, 360))
    kept = q.keep_good(docs.selectExpr("*", "1 as n_words", "'x' as _text_"))
    assert kept.columns == ["doc_id", "text", "n_words", "_text_"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(300)))
    assert q.scores(docs.limit(0)).count() == 0 and q.keep_good(docs.limit(0)).count() == 0
