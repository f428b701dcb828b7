"""The stages of the pipeline, each on what the one before kept."""

import random

import corpus_pipeline
from quern.llm import line_templates, packing, quality_rules, simhash, suffix_dedup
from quern.llm.common import table

from .test_line_templates import brute as brute_lines
from .shingles import components
from .test_packing import check as check_packing
from .test_quality_rules import plain_quality
from .test_suffix_dedup import brute as brute_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgéh") for _ in range(rnd.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(40)
    rows = [(i, "\n".join([prose(60), "All rights reserved by them.", prose(50)]), "en", "s", 1) for i in range(60)]
    rows += [(i, f"{prose(80)} {passage} {prose(80)}", "en", "s", 1) for i in range(60, 70)]
    rows += [(i, rows[3][1], "en", "s", 1) for i in range(70, 74)]
    rows += [(80, "$$$ ".join(prose(60).split()), "en", "s", 1), (81, "short", None, None, None), (82, None, "en", "s", None), (83, "", "en", "s", 0)]
    rows += [(90, prose(5000), "en", "s", 1), (None, prose(60), "en", "s", 1), (91, rows[0][1], "en", "s", 1), (91, rows[0][1], "en", "s", 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark):
    docs = frame(spark, corpus()).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "suffix_dedup", "packing"]

    kept = table(stages["quality_rules"](spark, docs, ""), "t")
    rows = texts(docs)
    want = {i for (i, _), (good, _) in zip(rows, plain_quality([t for _, t in rows])) if good}
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == want
    assert not want & {80, 81, 82, 83} and set(range(74)) <= want

    lines = table(stages["line_dedup"](spark, kept, ""), "t")
    assert lines.columns == COLUMNS and lines.count() == kept.count()
    assert sorted(len(t) for _, t in texts(lines)) == sorted(r[4] for r in brute_lines(texts(kept)))
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = table(stages["near_duplicates"](spark, lines, ""), "t")
    rows = sorted(set(texts(lines)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert near.columns == COLUMNS and sorted(str(r.doc_id) for r in near.collect()) == sorted(str(rows[i][0]) for i in components([t for _, t in rows]))

    cut = table(stages["suffix_dedup"](spark, near, ""), "t")
    want = brute_spans(texts(near))
    assert cut.columns == COLUMNS and cut.count() == near.count()
    lost = sum(len(t.encode()) for _, t in texts(near)) - sum(len(t.encode()) for _, t in texts(cut))
    assert 0 <= lost - sum(r[1] for r in want) <= 2 * sum(r[2] for r in want)  # and characters that a cut broke

    check_packing(stages["packing"](spark, cut, "").collect(), texts(cut))


def test_empty_and_odd_columns(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
    odd = frame(spark, corpus()).selectExpr("*", "1 AS id", "2 AS th", "3 AS _id", "'x' AS `Text_`", "4 AS n_words", "5 AS spans", "6 AS lines", "7 AS fp", "8 AS part")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == COLUMNS, name
    for out in (quality_rules.keep_good(odd), line_templates.drop_recurring(odd), simhash.keep_one(odd), suffix_dedup.remove_repeats(odd)):
        assert out.columns == odd.columns and out.count() > 0
    assert packing.pack(odd).count() > 0
