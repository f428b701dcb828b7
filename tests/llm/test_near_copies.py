import random

import pytest

import corpus_pipeline
from quern.llm import near_copies
from quern.llm.near_copies import keep_one

from .shingles import components, jaccard, shingle_set


def planted():
    """Texts of 200 and 1000 words with words changed at even distances: similarities from 0.67 to 0.98."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8)))
    out = []
    for n, changes in [(200, 1), (200, 2), (200, 3), (200, 4), (200, 8), (1000, 10), (1000, 20), (1000, 40)]:
        for _ in range(12):
            text = [word() for _ in range(n)]
            near = list(text)
            for k in range(changes):
                near[n * (2 * k + 1) // (2 * changes)] = word()
            out += [" ".join(text), " ".join(near).upper()]
    chain = [word() for _ in range(200)]
    for k in range(6):
        chain[20 + 30 * k : 23 + 30 * k] = [word() for _ in range(3)]
        out.append(" ".join(chain))
    common = " ".join(word() for _ in range(60))
    out += [common + " " + " ".join(word() for _ in range(60)) for _ in range(60)]
    return [*out, "a b", "A  b", "", None, " \n"]


def test_against_all_pairs(spark):
    texts = planted()
    pairs = [jaccard(shingle_set(texts[i]), shingle_set(texts[i + 1])) for i in range(0, 192, 2)]
    assert sum(0.8 <= s < 0.95 for s in pairs) >= 36 and sum(s < 0.8 for s in pairs) >= 24
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as set", "2 as _id").repartition(4)
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(components(texts))
    assert keep_one(docs.limit(0)).count() == 0


def test_stage_drops_near_copies(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == components(texts)


def test_null_and_repeated_ids(spark):
    rows = [(None, "x y z"), (7, "x y z"), (7, "x y z"), (None, "only here"), (9, "some other text that is longer")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(kept.collect(), key=str) == sorted([(7, "x y z"), (None, "only here"), (9, "some other text that is longer")], key=str)


@pytest.mark.parametrize("chunk", [2_000, 20_000, 200_000])
def test_chunks(spark, monkeypatch, chunk):
    """Components of many chunks: near copies of one text, beside texts that share a band with them but aren't alike."""
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    monkeypatch.setattr(near_copies, "ROWS", 2)  # bands that bring unlike texts together
    monkeypatch.setattr(near_copies, "BANDS", 10)
    monkeypatch.setattr(near_copies, "_TURN", near_copies._TURN[:20])
    monkeypatch.setattr(near_copies, "_TIMES", near_copies._TIMES[:20])
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8)))
    base = [word() for _ in range(150)]
    texts = []
    for k in range(160):
        text = list(base)
        for _ in range(rnd.choice([1, 2, 6, 12])):
            text[rnd.randrange(150)] = word()
        texts.append(" ".join(text))
    texts += [" ".join([*base[:75], *(word() for _ in range(75))]) for _ in range(20)]
    texts += [texts[-1] + " and", texts[-2] + " or"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(components(texts))
