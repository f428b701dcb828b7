"""Classification and rollup queries, with vocabularies that occur in the test texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from .registry import query
from .scoring import RECORD, record

THEMES = {"english": ("the", "and"), "german": ("der", "und"), "french": ("les", "que"), "spanish": ("los", "que")}
METHODS = {"heating": ("the", "there"), "mixing": ("und", "ing"), "resting": ("que", "est")}


def hit(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def hits(text, words):
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {hit('lower(text)', w)} THEN '{n}'" for n, w in THEMES.items()) + " ELSE 'Other' END AS category FROM documents")
def keyword_category(t):
    return t("documents").select("doc_id", C.first_category(F.col("text"), THEMES).alias("category"))


@query("SELECT doc_id, CASE WHEN a <> '' THEN a WHEN contains(lower(text), 'ing') THEN 'english' ELSE 'International' END AS found FROM (SELECT doc_id, text, array_to_string([x for x in [" + ", ".join(f"CASE WHEN {hits('lower(text)', w)} >= 2 THEN '{n}' END" for n, w in THEMES.items()) + "] if x IS NOT NULL], '|') AS a FROM documents)")
def theme_detection(t):
    found = C.categories(F.col("text"), THEMES, 2, {"english": ("ing",)}, "International")
    return t("documents").select("doc_id", F.array_join(found, "|").alias("found"))


@query(f"SELECT doc_id, CASE WHEN a <> '' THEN a WHEN prep + cook > 45 OR len(items) > 8 THEN 'Dinner' ELSE 'Lunch' END AS types FROM (SELECT *, array_to_string([x for x in [CASE WHEN {hit('lower(text)', ('und',))} THEN 'Morning' END, CASE WHEN prep + cook <= 15 THEN 'Snack' END, CASE WHEN len([x for x in items if regexp_matches(lower(x), 'egg|bacon')]) > 0 THEN 'Breakfast' END] if x IS NOT NULL], '|') AS a FROM {RECORD})")
def meal_type_detection(t):
    found = C.meal_types(F.col("text"), {"Morning": ("und",)}, F.col("items"), F.col("prep") + F.col("cook"))
    return record(t).select("doc_id", F.array_join(found, "|").alias("types"))


RULES = {"no-the": ((), ("the",)), "no-und": (("einheit",), ("und",)), "no-que": ((), ("que", "les"))}


@query(f"SELECT doc_id, array_to_string([x for x in [CASE WHEN NOT contains(j, 'the') THEN 'no-the' END, CASE WHEN contains(lower(text), 'einheit') OR NOT contains(j, 'und') THEN 'no-und' END, CASE WHEN NOT (contains(j, 'que') OR contains(j, 'les')) THEN 'no-que' END] if x IS NOT NULL], '|') AS rules, CAST(len([x for x in items if contains(lower(x), 'the')]) AS INTEGER) AS broken FROM (SELECT *, lower(array_to_string(items, ' | ')) AS j FROM {RECORD})")
def rule_eligibility(t):
    return record(t).select("doc_id", F.array_join(C.eligible(F.col("items"), F.col("text"), RULES), "|").alias("rules"), F.size(C.violations(F.col("items"), ("the",))).alias("broken"))


def count_steps(words):
    return f"len([x for x in steps if {hit('lower(x)', words)}])"


@query(f"SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'heating' WHEN b >= c THEN 'mixing' ELSE 'resting' END AS method FROM (SELECT doc_id, {count_steps(METHODS['heating'])} AS a, {count_steps(METHODS['mixing'])} AS b, {count_steps(METHODS['resting'])} AS c FROM {RECORD})")
def primary_method(t):
    return record(t).select("doc_id", C.primary(F.col("steps"), METHODS).alias("method"))


@query("SELECT doc_id, CASE WHEN a = '' THEN 'Mixed' ELSE a END AS methods FROM (SELECT doc_id, array_to_string([x for x in [" + ", ".join(f"CASE WHEN {hit('lower(text)', w)} THEN '{n}' END" for n, w in METHODS.items()) + "] if x IS NOT NULL], '|') AS a FROM documents)")
def methods_set(t):
    return t("documents").select("doc_id", F.array_join(C.methods_used(F.col("text"), METHODS), "|").alias("methods"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(l, '\\bthe\\b') THEN 'the' WHEN regexp_matches(l, '\\bund\\b') THEN 'und' WHEN contains(l, 'the') THEN 'the' WHEN contains(l, 'und') THEN 'und' ELSE 'none' END AS value,
  CASE WHEN regexp_matches(l, '\\bthe\\b|\\bund\\b') THEN 0.95 WHEN contains(l, 'the') OR contains(l, 'und') THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT conv_id, turn, lower(regexp_replace(text, '[^ -~]', '', 'g')) AS l FROM conversations)""")
def dictionary_extraction(t):
    rows = t("conversations").select("conv_id", "turn", F.regexp_replace("text", "[^ -~]", "").alias("text"))
    return rows.select("conv_id", "turn", C.extracted(F.col("text"), ("the", "und"), "none").alias("e")).select("conv_id", "turn", "e.*")


@query("""SELECT conv_id, turn, CAST(i AS INTEGER) AS step_number, s AS text, CASE WHEN contains(lower(s), 'the') THEN 'the' WHEN contains(lower(s), 'que') THEN 'que' END AS action FROM (SELECT conv_id, turn, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, [y for y in [trim(x) for x in string_split(text, chr(10))] if y <> ''] AS l FROM conversations))""")
def step_assembly(t):
    steps = C.structured_steps(T.lines(F.col("text")), ("the", "que"))
    return t("conversations").select("conv_id", "turn", F.inline(steps))


@query(r"""SELECT conv_id, turn, unnest(list_reduce([[]::VARCHAR[]] || [[z] for z in parts], lambda acc, x: CASE WHEN len(acc) = 0 OR contains(lower(x[1]), 'the') OR contains(lower(x[1]), 'der') OR contains(lower(x[1]), 'les') OR contains(lower(x[1]), 'los') THEN acc || x ELSE acc[1 : len(acc) - 1] || [acc[len(acc)] || ' and ' || x[1]] END)) AS step
  FROM (SELECT conv_id, turn, [y for y in [trim(x) for x in regexp_split_to_array(text, '(?i)[.!?;]+\s*|,?\s+(?:then|and then|and)\s+')] if y <> ''] AS parts FROM conversations)""")
def atomic_steps(t):
    return t("conversations").select("conv_id", "turn", F.explode(C.atomic_steps(F.col("text"), ("the", "der", "les", "los"))).alias("step"))


@query("SELECT doc_id, CAST(greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS INTEGER) AS n FROM (SELECT doc_id, string_split(split_part(text, chr(10), 1), ' ') AS w FROM documents)")
def ngram_candidates(t):
    w = F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " ")
    return t("documents").select("doc_id", (F.size(C.ngrams(w, 2)) + F.size(C.ngrams(w, 3))).alias("n"))


@query("""SELECT doc_id, round(CASE WHEN n > 0 THEN a / n ELSE 0 END, 6)::DOUBLE AS x0, round(CASE WHEN n > 0 THEN b / n ELSE 0 END, 6)::DOUBLE AS x1, round(CASE WHEN n > 0 THEN c / n ELSE 0 END, 6)::DOUBLE AS x2 FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (
  SELECT doc_id, (length(l) - length(replace(l, 'the', ''))) / 3 * 1.0 AS a, (length(l) - length(replace(l, 'und', ''))) / 3 * 2.0 AS b, (length(l) - length(replace(l, 'que', ''))) / 3 * 0.5 AS c FROM (SELECT doc_id, lower(text) AS l FROM documents)))""")
def rule_embedding(t):
    e = t("documents").select("doc_id", C.rule_embedding(F.col("text"), {"the": 1.0, "und": 2.0, "que": 0.5}).alias("e"))
    return e.select("doc_id", *(F.round(F.get("e", i), 6).alias(f"x{i}") for i in range(3)))


@query("""WITH RECURSIVE h(p_partkey, s, i, v) AS (SELECT p_partkey, p_name, 0, 0::BIGINT FROM part UNION ALL SELECT p_partkey, s, i + 1, ((v * 31 + ascii(s[i + 1]) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 FROM h WHERE i < length(s)),
  e AS (SELECT p_partkey, [sin((abs(v) + i * 7919)::DOUBLE) for i in range(768)] AS e FROM h WHERE i = length(s)), u AS (SELECT p_partkey, e, sqrt(list_sum([x * x for x in e])) AS n FROM e)
  SELECT p_partkey, round(e[1] / n, 6) AS first, round(e[768] / n, 6) AS last, round(list_sum([abs(x) for x in e]) / n, 4) AS total FROM u""")
def hash_embedding(t):
    e = t("part").select("p_partkey", C.hash_embedding(F.col("p_name")).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.abs(x))
    return e.select("p_partkey", F.round(F.get("e", 0), 6).alias("first"), F.round(F.get("e", 767), 6).alias("last"), F.round(total, 4).alias("total"))


@query("""SELECT l_orderkey, round(sum(l_quantity * coalesce(CASE WHEN p_size % 2 = 0 THEN p_retailprice / 10 END, CASE WHEN p_size % 3 = 0 THEN p_size END, 1.0) / 100) / 4, 6) AS per_serving, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def weighted_rollup_per_parent(t):
    value = F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") / 10), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("double")), F.lit(1.0))
    parts = t("part").select("p_partkey", value.alias("per_hundred"))
    rows = t("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("per_hundred") / 100) / 4, 6).alias("per_serving"), F.count("*").alias("n"))
