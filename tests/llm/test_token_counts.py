import random

from tokenizers import Tokenizer

from quern.llm import merge_automaton
from quern.llm import token_counts as tc
from quern.llm.vocabulary import default_path

PATH = default_path("byte_bpe_50k.json")


def texts():
    rnd = random.Random(8)
    parts = ["'s", "'re", "'r", "'ll", "'l", "'ve", "'", "''", "s", "re", "e", "l", " ", "  ", "\n", "\t ", " \n", "\x85", "　", "1", "42", "½", "é", "世界", "word", "A", "!", "$%", "Ᲊ", "՘", "<|endoftext|>", "<|", "\0", "\x1c", "🙂", "́", "x" * 9, "y" * 40]
    out = ["", "x" * 5000, " " * 700, "a b" * 3000, "'re", "'r", "<|endoftext|>", "  <|endoftext|>  "]
    return out + ["".join(rnd.choice(parts) for _ in range(rnd.choice([1, 2, 3, 5, 30, 300]))) for _ in range(1500)]


def test_counts_and_ids():
    tok = Tokenizer.from_file(PATH)
    data = texts()
    ids = [tok.encode(t, add_special_tokens=False).ids for t in data]
    assert tc.count(data, PATH).tolist() == [len(x) for x in ids]
    assert tc.ids(data, PATH) == [b"".join(i.to_bytes(4, "little") for i in x) for x in ids]
    assert tc.count([], PATH).tolist() == []


def every_code_point():
    """Each code point after a letter, a number, another sign, a space and itself, in texts of 4,096."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    return ["".join(f"a{c}1{c}!{c} {c}{c}" for c in map(chr, points[i : i + 4096])) for i in range(0, len(points), 4096)]


def test_every_code_point():
    tok = Tokenizer.from_file(PATH)
    data = every_code_point()
    assert tc.count(data, PATH).tolist() == [len(x.ids) for x in tok.encode_batch(data, add_special_tokens=False)]


def test_long_texts():
    rnd = random.Random(2)
    tok = Tokenizer.from_file(PATH)
    word = "".join(rnd.choice("etaoin") for _ in range(100_000))
    data = ["word " * 1_000_000, "x" * 5_000_000, word, word + " " + word[::-1], "".join(rnd.choice("世界和平的人在一不了有") for _ in range(50_000))]
    ids = [tok.encode(t, add_special_tokens=False).ids for t in data]
    assert tc.count(data, PATH).tolist() == [len(x) for x in ids]
    assert tc.ids(data[2:], PATH) == [b"".join(i.to_bytes(4, "little") for i in x) for x in ids[2:]]


def test_few_states(monkeypatch):
    """States that make room for others are compiled again."""
    automaton = merge_automaton.MergeAutomaton(PATH)
    monkeypatch.setattr(merge_automaton, "STATES", 500)
    monkeypatch.setitem(merge_automaton.MergeAutomaton._open, PATH, automaton)
    tok = Tokenizer.from_file(PATH)
    data = [*texts()[:300], "".join(random.Random(3).choice("etaoinshrdlu") for _ in range(5000))]
    ids = [tok.encode(t, add_special_tokens=False).ids for t in data]
    assert tc.count(data, PATH).tolist() == [len(x) for x in ids]
    assert tc.ids(data, PATH) == [b"".join(i.to_bytes(4, "little") for i in x) for x in ids]


def test_lanes():
    import numpy as np

    rnd = np.random.default_rng(1)
    classes = rnd.integers(0, 12, 20_000).astype(np.uint8)
    classes[5000:9000] = tc.LETTER  # lanes that don't come to one state
    classes[12_000:13_000] = tc.OTHER_SPACE
    one = tc.piece_starts(classes, lanes=1)
    for lanes in (2, 7, 64, 300):
        assert (tc.piece_starts(classes, lanes) == one).all()


def test_query(spark):
    rows = [(None, None), (1, ""), (2, "hello world"), (2, "hello world"), (3, "a" + " b" * 600)]
    got = sorted(tuple(r) for r in tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_tokens")).collect() if r[0])
    assert got == [(1, 0, 0, False), (2, 11, 2, False), (2, 11, 2, False), (3, 1201, 601, True)]
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
