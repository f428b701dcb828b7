"""Literals and invariants of the expressions and operators."""

import itertools
import random

from pyspark.sql import functions as F

from quern.functions import similarity as S
from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import dedup as D
from quern.operators import extract as X
from quern.operators import graph as G
from quern.operators import merge as M
from quern.plans import catalog
from quern.sources import tables as ST


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_literals(spark):
    title = lambda s: one(spark, T.title_key(F.lit(s)))
    assert title("The Best Chocolate Chip Cookies") == "chocolate chip cooky"
    assert title("Easy Apple Pies") == "apple py"
    assert title("cookies recipe") == "cookies"  # the space that is left keeps the s
    assert one(spark, T.clean_ingredient(F.lit("½ cup® sugar , "))) == "1/2 cup sugar"
    assert one(spark, T.decode_entities(F.lit("caf&#233; &amp;lt; &#x20AC;"))) == "café < €"
    assert one(spark, T.expand(F.lit("2 tbsp.sugar thru"))) == "2 tablespoonsugar through"
    assert one(spark, T.servings(F.lit("Serves 4 people"))) == 4 and one(spark, T.servings(F.lit("serves 400"))) is None
    assert one(spark, T.capitalize_words(F.lit("a bC-d"))) == "A BC-D"
    assert one(spark, T.valid_line(F.lit("cup"))) and not one(spark, T.valid_line(F.lit("42")))


def test_phonetic(spark):
    for word, code in (("Tymczak", "T520"), ("Pfister", "P236"), ("", ""), ("Robert", "R163"), ("a", "A000")):
        assert one(spark, S.phonetic(F.lit(word))) == code


def test_similarity_bounds(spark):
    words = ["", "a", "ab", "ring", "string", "bolt"]
    pairs = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    for r in pairs.select("a", "b", S.similarity(F.col("a"), F.col("b")).alias("s"), S.similarity(F.col("b"), F.col("a")).alias("t"), S.jaccard(F.split("a", ""), F.split("b", "")).alias("j")).collect():
        assert r.s == r.t and 0 <= r.s <= 1 and 0 <= r.j <= 1 and (r.s == 1) == (r.a == r.b)


def test_urls(spark):
    assert one(spark, U.cache_key(F.lit("http://a.b/c?utm_source=x&q=1&gclid=2#f"))) == "recipe:v2:http://a.b/c?q=1#f"
    assert one(spark, U.absolute(F.lit("y"), F.lit("http://a.b/c/d"))) == "http://a.b/c/y"
    base = "https://a.b/c/d/e?x=1#top"
    links = {"//cdn.org/x": "https://cdn.org/x", "../y": "https://a.b/c/y", "../../../y?q": "https://a.b/y?q", "./": "https://a.b/c/d/", "..": "https://a.b/c/", "?q=2": "https://a.b/c/d/e?q=2", "#end": "https://a.b/c/d/e?x=1#end", "": "https://a.b/c/d/e?x=1", "/p/./q/../r": "https://a.b/p/r", "mailto:a@b.c": "mailto:a@b.c"}
    for link, want in links.items():
        assert one(spark, U.absolute(F.lit(link), F.lit(base))) == want
        assert one(spark, U.absolute(F.lit(link), F.lit("no base"))) == (link if ":" in link else None)
    assert one(spark, U.fingerprint(F.lit("no url"))) is None
    assert one(spark, U.slug_title(F.lit("http://a.b/recipes/big-pie"))) == "Big Pie"
    screen = one(spark, U.compliance(F.lit("http://a.b/premium/food-photography")))
    assert not screen.can_scrape and screen.restrictions == ["paywall"]


def test_token_pairs_and_greedy(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 7))]) for i in range(150)]
    frame = spark.createDataFrame(rows, "id long, t array<string>")
    for least in (0.5, 0.75):
        want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if a and b and len(set(a) & set(b)) >= least * len(set(a) | set(b))}
        pairs = {(r.a, r.b) for r in D.token_pairs(frame, "id", "t", least).collect()}
        sets = {i: frozenset(t) for i, t in rows}
        first = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
        assert pairs <= want
        assert {(i, j) for i, j in want if first[sets[i]] == i and first[sets[j]] == j} <= pairs
    kept, accepted = D.greedy(frame, D.token_pairs(frame, "id", "t", 0.75), "id"), []
    for i, t in rows:
        if not any(t and sets[j] and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]) for j in accepted):
            accepted.append(i)
    assert sorted(r.id for r in kept.collect()) == accepted


def test_greedy_chain(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "a long, b long")
    assert sorted(r.id for r in D.greedy(rows, edges, "id").collect()) == [0, 2, 4, 5]


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    got = G.reach(edges, spark.createDataFrame([("a",)], "node string"), 10)
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_merge_ties(spark):
    rows = [("k", 1, 50, "", ["x"], ["1", "2"]), ("k", 2, 90, "", ["y"], ["3", "4"]), ("k", 3, 90, "late", ["x"], ["5"])]
    frame = spark.createDataFrame(rows, "k string, seq int, conf int, d string, tags array<string>, items array<string>")
    r = M.coalesced(frame, "k", "conf", "seq", ["d"], "tags", ["items"]).first()
    assert (r.d, r.tags, r["items"], r.conf) == ("late", ["y", "x"], ["3", "4"], 77)


def test_microdata():
    page = '<div itemprop="name">Pie</div><li itemprop="recipeIngredient">a <b>b</b></li><script>"<li>x</li>"</script><li>plain</li><meta name="author" content="Ann">'
    got = X.parse(page)
    assert (got["title"], got["items"], got["author"], got["method"]) == ("Pie", ["a b"], "Ann", "microdata")
    assert X.parse(None)["title"] is None and X.parse("<p>a<p>b<![x")["steps"]


def test_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("category,name,url,sitemap,subs\nMajor , A ,http://a.com/x,,s1; s2\n,B,http://a.com/y,,\nx,C,nothing,,\n")
    rows = ST.site_list(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.name, r.sub_sitemaps) for r in rows] == [("A", ["s1", "s2"])]
    (tmp_path / "l.json").write_text('{"url": "u", "error": "e"}\nnot json\n\n')
    assert ST.json_log(spark, str(tmp_path / "l.json"), "url string, error string").count() == 1
    frame = spark.createDataFrame([(1, 'say "x"', ["a", "b"])], "id int, t string, l array<string>")
    ST.export_csv(frame, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"').first()
    assert (back.t, back.l) == ('say "x"', '["a","b"]')
    (tmp_path / "r.json").write_text('{"a.com": {"domain": "a.com", "attemptCount": 3, "isTemporary": true}}')
    assert ST.registry(spark, str(tmp_path / "r.json")).first().attemptCount == 3


def test_hooks(spark):
    from quern.plans.workflow import Hooks, model_hook

    hooks = Hooks()
    hooks.add("enrich", "length", model_hook(lambda batch: batch["t"].str.len(), "n", "long"))
    hooks.add("parse", "trim", lambda df: df.withColumn("t", F.trim("t")))
    assert hooks.run(spark.createDataFrame([(" ab ",)], "t string")).first().n == 2


def test_numbered(spark):
    from quern.operators.report import numbered

    words = [(f"w{n:03d}",) for n in range(57)]
    random.Random(1).shuffle(words)
    got = numbered(spark.createDataFrame(words, "w string").repartition(5), "w").collect()
    assert sorted((r.number, r.w) for r in got) == list(enumerate(sorted(w for w, in words), 1))
    assert numbered(spark.createDataFrame([], "w string"), "w").count() == 0


def test_stream_windows(spark, tmp_path):
    from quern.streaming import windows as W

    rows = [(i, i % 2, 60 * i) for i in range(10)] + [(99, 0, 100_000), (100, 0, 200_000)]
    frame = spark.createDataFrame(rows, "id long, k long, s long").withColumn("ts", F.timestamp_seconds("s"))
    for n, part in enumerate((frame.where("id < 50"), frame.where("id = 99"), frame.where("id = 100"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    found = {}
    for name, df in (("tumbling", W.tumbling(stream, "ts", "5 minutes", "1 minute")), ("sliding", W.sliding(stream, "ts", "10 minutes", "5 minutes", "1 minute")), ("sessions", W.sessions(stream, "ts", "10 minutes", "1 minute", "k")), ("firsts", W.first_of_key(stream, "ts", "1 hour", F.col("k")))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        found[name] = spark.sql(f"SELECT * FROM {name}").collect()
    assert sorted(r.n for r in found["tumbling"]) == [1, 5, 5]
    assert sorted(r.n for r in found["sessions"]) == [1, 5, 5]
    assert sum(r.n for r in found["sliding"] if r.n > 1) == 20
    assert {0, 1} <= {r.k for r in found["firsts"]}


def test_hit_rates_round_as_printf(spark, tmp_path):
    """Halves that a double holds exactly go to the even cent: 1 of 32 is 3.125."""
    rows = [(user, "view" if i < hits else "click") for user, (hits, n) in enumerate([(1, 32), (3, 32), (1, 800), (7, 7), (0, 3), (201, 20000)]) for i in range(n)]
    spark.createDataFrame(rows, "user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["hit_rates"](spark, str(tmp_path)).orderBy("user_id").collect()
    assert [r.hit_rate for r in got] == ["3.12%", "9.38%", "0.12%", "100.00%", "0.00%", "1.00%"]
