"""Scoring queries over a record built from documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from .registry import query

RECORD = """(SELECT doc_id, text, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS description, source AS author, 'http://' || source AS source_url, CASE WHEN toxic = 1 THEN 'x' ELSE '' END AS image_url,
  [y for y in [trim(x) for x in string_split(text, chr(10))] if y <> ''] AS items, [y for y in [trim(x) for x in regexp_split_to_array(text, '[.!?]+')] if y <> ''] AS steps, [lang, source] AS tags,
  n_chars % 50 AS prep, (n_chars // 50) % 100 AS cook, n_chars % 50 + (n_chars // 50) % 100 + (n_chars % 7) * 5 AS total, n_chars % 60 AS servings, n_chars % 6000 AS calories, quality
  FROM documents LEFT JOIN labels USING (doc_id)) r"""


def record(t):
    n = F.col("n_chars")
    steps = F.filter(F.transform(F.split("text", "[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")
    prep, cook = n % 50, F.floor(n / 50) % 100
    return t("documents").join(t("labels"), "doc_id", "left").select(
        "doc_id", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.split_part("text", F.lit("\n"), F.lit(2)).alias("description"), F.col("source").alias("author"),
        F.concat(F.lit("http://"), "source").alias("source_url"), F.when(F.col("toxic") == 1, "x").otherwise("").alias("image_url"), T.lines(F.col("text")).alias("items"), steps.alias("steps"),
        F.array("lang", "source").alias("tags"), prep.alias("prep"), cook.alias("cook"), (prep + cook + (n % 7) * 5).alias("total"), (n % 60).alias("servings"), (n % 6000).alias("calories"), "quality",
    )


NAMES = ("title", "description", "author", "source_url", "image_url", "items", "steps", "tags", "prep", "cook", "total", "servings", "calories")


def fields():
    return {k: F.col(k) for k in NAMES}


def b(sql, n):
    return f"CASE WHEN {sql} THEN {n} ELSE 0 END"


def add(*rules):
    return " + ".join(b(*r) for r in rules)


P = {k: f"{k} <> ''" for k in ("title", "description", "author", "source_url", "image_url")} | {k: f"len({k}) > 0" for k in ("items", "steps", "tags")} | {k: f"{k} <> 0" for k in ("prep", "cook", "total", "servings", "calories")}
ANY = "len([x for x in {0} if regexp_matches(x, '{1}')]) > 0"


@query(f"SELECT doc_id, CAST(least({add(('length(title) > 5', 15), ('length(description) > 20', 10), ('len(items) >= 3', 20), ('len(items) >= 3 AND ' + ANY.format('items', '[0-9]') + ' AND ' + ANY.format('items', '(?i)cup|gram|ounce'), 5), ('len(steps) >= 2', 20), ('len(steps) >= 2 AND ' + ANY.format('steps', '(?i)bake|mix|stir'), 5), (P['calories'], 10), (P['prep'] + ' OR ' + P['cook'], 5), (P['total'], 5), (P['servings'], 2), (P['tags'], 1))}, 100) AS INTEGER) AS score FROM {RECORD}")
def completeness_a(t):
    return record(t).select("doc_id", S.completeness_a(fields()).cast("int").alias("score"))


@query(f"SELECT doc_id, CAST(least({add(*((P[x], 10) for x in ('title', 'description', 'items', 'steps', 'prep', 'cook', 'image_url')), *((P[x], 5) for x in ('servings', 'author', 'tags')))}, 100) AS INTEGER) AS score FROM {RECORD}")
def completeness_b(t):
    return record(t).select("doc_id", S.completeness_b(fields()).cast("int").alias("score"))


@query(f"SELECT doc_id, CAST(least({add((P['title'], 10), (P['items'], 25), (P['steps'], 25), (P['image_url'], 5), (P['servings'], 5), (P['prep'] + ' OR ' + P['cook'] + ' OR ' + P['total'], 5), (P['description'], 5), (P['calories'], 10), (P['tags'], 5))}, 100) AS INTEGER) AS score FROM {RECORD}")
def completeness_c(t):
    return record(t).select("doc_id", S.completeness_c(fields()).cast("int").alias("score"))


def pct(inner, of):
    return f"CAST(floor(({inner}) / {of}.0 * 100 + 0.5) AS INTEGER)"


@query(f"SELECT doc_id, {pct(add(*((P[x], 1) for x in ('title', 'description', 'items', 'steps', 'prep', 'cook', 'servings', 'tags', 'author', 'image_url', 'source_url')), ('len(items) >= 3', 1)), 15)} AS score FROM {RECORD}")
def completeness_d(t):
    return record(t).select("doc_id", S.completeness_d(fields()).cast("int").alias("score"))


@query(f"SELECT doc_id, {pct(add(*((P[x], 1) for x in ('title', 'description', 'prep', 'cook', 'servings', 'tags', 'image_url', 'author', 'calories')), ('len(items) >= 3', 1), ('len(steps) >= 2', 1)), 15)} AS score FROM {RECORD}")
def completeness_e(t):
    return record(t).select("doc_id", S.completeness_e(fields()).cast("int").alias("score"))


@query(f"SELECT doc_id, {pct(add(*((P[x], 5) for x in ('title', 'items', 'steps', 'source_url')), *((P[x], 3) for x in ('description', 'author', 'prep', 'cook', 'servings', 'image_url')), *((P[x], 1) for x in ('tags', 'calories'))), 44)} AS score FROM {RECORD}")
def completeness_f(t):
    return record(t).select("doc_id", S.completeness_f(fields()).cast("int").alias("score"))


@query(f"SELECT doc_id, {pct(add(*((P[x], 2) for x in ('title', 'source_url', 'items', 'steps', 'author', 'prep', 'cook', 'total', 'servings')), *((P[x], 1) for x in ('description', 'image_url', 'tags', 'calories'))), 27)} AS score FROM {RECORD}")
def completeness_g(t):
    return record(t).select("doc_id", S.completeness_g(fields()).cast("int").alias("score"))


@query(f"SELECT doc_id, round(({add(*((P[x], 1) for x in ('title', 'items', 'steps', 'prep', 'servings')))}) / 5.0, 6)::DOUBLE AS governance, least({add(*((P[x], 17.5) for x in ('title', 'description', 'items', 'steps')), *((P[x], 10.0) for x in ('image_url', 'author', 'tags')))}, 100.0)::DOUBLE AS media FROM {RECORD}")
def completeness_other(t):
    return record(t).select("doc_id", F.round(S.completeness_governance(fields()), 6).alias("governance"), S.completeness_media(fields()).cast("double").alias("media"))


LEN = "list_sum([length(x) for x in {0}]) / len({0})"


@query(f"SELECT doc_id, CAST(least({add((P['title'], 20), (P['items'], 30), (P['steps'], 30), (P['items'], 10), (ANY.format('steps', '(?i)bake|mix|stir'), 10))}, 100) AS INTEGER) AS presence, CAST(50 + {add(('len(items) > 0 AND ' + LEN.format('items') + ' > 3', 15), ('len(steps) > 0 AND ' + LEN.format('steps') + ' > 20', 15), (P['servings'] + ' AND ' + P['prep'], 10))} AS INTEGER) AS means, CAST(least(95, 70 + len(items) * 2 + len(steps) * 3) AS INTEGER) AS counts FROM {RECORD}")
def parsing_confidence(t):
    r = fields()
    return record(t).select("doc_id", S.confidence_presence(r).cast("int").alias("presence"), S.confidence_means(r).cast("int").alias("means"), S.confidence_counts(r).cast("int").alias("counts"))


RE_MEASURED = "[0-9]+\\s*(cup|tablespoon|teaspoon|pound|ounce|gram|kilogram|ml|liter)|[0-9]+/[0-9]+|[0-9]+\\s*-\\s*[0-9]+"
RE_ACTED = "(^|[^a-z0-9_])(preheat|heat|cook|bake|sauté|simmer|boil|mix|stir|add|remove)([^a-z0-9_]|$)|[0-9]+\\s*(minute|hour|second)|[0-9]+°[cf]"
ITEMQ = f"CASE WHEN len(items) > 0 THEN list_sum([CASE WHEN regexp_matches(lower(x), '{RE_MEASURED}') THEN 1.0 ELSE 0.0 END + CASE WHEN length(x) > 3 THEN 0.5 ELSE 0.0 END for x in items]) / (len(items) * 1.5) ELSE 0.0 END"
STEPQ = f"CASE WHEN len(steps) > 0 THEN list_sum([CASE WHEN regexp_matches(lower(x), '{RE_ACTED}') THEN 1.0 ELSE 0.0 END + CASE WHEN length(x) > 10 THEN 0.5 ELSE 0.0 END + CASE WHEN regexp_matches(lower(x), '[0-9]+\\s*(minute|hour|°[cf])') THEN 0.3 ELSE 0.0 END for x in steps]) / (len(steps) * 1.8) ELSE 0.0 END"
QUALITY = f"""(SELECT *, greatest(0.0, 1.0 - {b('spam', 0.5)} - {b('poor', 0.3)} - {b('iq < 0.5', 0.2)} - {b('sq < 0.5', 0.2)} - {b("title <> '' AND length(title) < 10", 0.1)}) AS content, NOT ((prep <> 0 AND cook <> 0 AND total <> 0 AND abs(prep + cook - total) > (prep + cook) * 0.2) OR servings > 50 OR (servings > 10 AND len(items) < 2) OR calories > 5000) AS consistent
  FROM (SELECT *, {ITEMQ} AS iq, {STEPQ} AS sq, regexp_matches(lower(every), 'buy now|click here|special offer|limited time|(viagra|casino|poker|lottery)') AS spam, regexp_matches(lower(every), 'lorem ipsum|placeholder|\\[.*\\]|xxx+|test') AS poor FROM (SELECT *, concat_ws(' ', title, description, array_to_string(items, ' '), array_to_string(steps, ' ')) AS every FROM {RECORD})))"""


@query(f"SELECT doc_id, round(iq, 4)::DOUBLE AS items, round(sq, 4)::DOUBLE AS steps, round(content, 4)::DOUBLE AS content, consistent FROM {QUALITY}")
def content_quality(t):
    r = fields()
    return record(t).select("doc_id", F.round(S.item_quality(r["items"]), 4).alias("items"), F.round(S.step_quality(r["steps"]), 4).alias("steps"), F.round(S.content_score(S.content_issues(r)), 4).alias("content"), (F.size(S.consistency_issues(r)) == 0).alias("consistent"))


SCORE = f"round(0.25 + ({add(('length(trim(title)) > 0', 1), ('len(items) >= 2', 1), ('len(steps) >= 1', 1), ('prep <> 0 OR cook <> 0 OR total <> 0', 1), ('servings <> 0', 1), ('calories <> 0', 1))}) / 6.0 * 0.35 + content * 0.30 + {b('consistent', 0.10)}, 6)::DOUBLE"


def scored(t):
    return record(t).withColumn("score", F.round(S.quality(fields(), F.lit(True)), 6))


@query(f"SELECT doc_id, {SCORE} AS score FROM {QUALITY}")
def quality_score(t):
    return scored(t).select("doc_id", "score")


@query(f"SELECT CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'middle' ELSE 'low' END AS tier, count(*) AS n, round(avg(score), 4) AS mean, count(*) FILTER (quality = 0) AS labelled_bad FROM (SELECT {SCORE} AS score, quality FROM {QUALITY}) GROUP BY 1")
def quality_tiers(t):
    tier = F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.5, "middle").otherwise("low")
    return scored(t).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.count_if(F.col("quality") == 0).alias("labelled_bad"))


@query(f"SELECT issue, count(*) AS n FROM (SELECT unnest([x for x in [CASE WHEN spam THEN 'spam' END, CASE WHEN poor THEN 'placeholder' END, CASE WHEN iq < 0.5 THEN 'items' END, CASE WHEN sq < 0.5 THEN 'steps' END, CASE WHEN title <> '' AND length(title) < 10 THEN 'title' END] if x IS NOT NULL]) AS issue FROM {QUALITY}) GROUP BY 1 ORDER BY n DESC, issue LIMIT 10")
def top_issues(t):
    rows = record(t).select(F.explode(S.content_issues(fields())).alias("issue"))
    return rows.groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(10)


@query(f"SELECT doc_id, prep <> 0 AND cook <> 0 AND total <> 0 AND abs(prep + cook - total) > 15 AS far_apart FROM {RECORD}")
def times_far_apart(t):
    return record(t).select("doc_id", S.times_far_apart(fields()).alias("far_apart"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'personal.*information|contact.*details|payment.*info|subscription.*data') THEN 'sensitive' WHEN regexp_matches(lower(text), 'proprietary|signature.*recipe|chef.*special|restaurant.*secret') THEN 'restricted' ELSE 'public' END AS class, regexp_matches(lower(text), 'email|phone|address') AS personal FROM documents")
def pii_classification(t):
    return t("documents").select("doc_id", S.classification(F.col("text")).alias("class"), S.personal(F.col("text")).alias("personal"))


BOUNDS = {"title": (1, 200), "servings": (1, 50), "total": (0, 120), "items": (1, 50), "steps": (1, 100)}


@query(f"SELECT doc_id, array_to_string([x for x in [{', '.join(f'CASE WHEN {m} < {lo} THEN ' + chr(39) + f'{k}: below {lo}' + chr(39) + f' END, CASE WHEN {m} > {hi} THEN ' + chr(39) + f'{k}: above {hi}' + chr(39) + ' END' for k, m, lo, hi in (('title', 'length(title)', 1, 200), ('servings', 'servings', 1, 50), ('total', 'total', 0, 120), ('items', 'len(items)', 1, 50), ('steps', 'len(steps)', 1, 100)))}] if x IS NOT NULL], '|') AS issues FROM {RECORD}")
def schema_issues(t):
    return record(t).select("doc_id", F.array_join(S.check_bounds(fields(), BOUNDS), "|").alias("issues"))


@query(f"SELECT doc_id, CAST(CASE WHEN servings <> 0 THEN greatest(1, least(50, servings)) ELSE 4 END AS BIGINT) AS servings, CAST(CASE WHEN prep <> 0 THEN prep ELSE greatest(10, len(items) * 2) END AS BIGINT) AS prep, CAST(CASE WHEN cook <> 0 THEN cook ELSE 15 END AS BIGINT) AS cook FROM {RECORD}")
def validate_and_fix(t):
    f = S.fixed(fields())
    return record(t).select("doc_id", *(f[k].cast("long").alias(k) for k in ("servings", "prep", "cook")))


@query("""SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(100, floor(50 + least(q, 30.0) + least(d * 200, 20.0) - least(x * 200, 20.0) - CASE WHEN e > 200 THEN least((e - 200) / 50, 20.0) ELSE 0 END - CASE WHEN q > 10 THEN least((q - 10) * 2, 20.0) ELSE 0 END + 0.5))) AS BIGINT) AS continuous,
  CAST(greatest(0, least(100, 50 + CASE WHEN q > 10 THEN 15 ELSE 0 END + CASE WHEN d * 100 > 5 THEN 15 ELSE 0 END + CASE WHEN e < 400 AND e > 0 THEN 10 ELSE 0 END - CASE WHEN x * 100 > 5 THEN 10 ELSE 0 END - CASE WHEN e > 600 THEN 10 ELSE 0 END - CASE WHEN q > 15 THEN 10 ELSE 0 END)) AS INTEGER) AS stepped
  FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_tax AS x, l_extendedprice / 100 AS e FROM lineitem)""")
def health_score_variants(t):
    q, d, x, e = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice") / 100
    n = {"protein": q, "fiber": d * 100, "saturated": x * 100, "sodium": e, "sugar": q, "fat": q, "carbs": q, "calories": e}
    return t("lineitem").select("l_orderkey", "l_linenumber", S.health_continuous(n).alias("continuous"), S.health_steps(n).cast("int").alias("stepped"))


@query("SELECT p_partkey, CAST(greatest(0, least(100, 50 + least(h * 5, 25) - least(u * 3, 15) + CASE WHEN p > 15 THEN 10 ELSE 0 END)) AS INTEGER) AS by_category, CAST(greatest(0, least(100, 75 + CASE WHEN p > 20 THEN 5 ELSE 0 END + CASE WHEN u / 10.0 > 0.3 THEN -15 WHEN u > 0 THEN -7 ELSE 0 END + CASE WHEN h / 10.0 > 0.5 THEN 15 WHEN h > 0 THEN 7 ELSE 0 END)) AS INTEGER) AS by_ratio FROM (SELECT p_partkey, p_size % 10 AS h, (p_size // 10) % 10 AS u, p_retailprice / 100 AS p FROM part)")
def health_by_class(t):
    h, u, p, z = F.col("p_size") % 10, F.floor(F.col("p_size") / 10) % 10, F.col("p_retailprice") / 100, F.lit(0.0)
    n = {"protein": p, "fiber": z, "saturated": z, "sodium": z, "sugar": z}
    return t("part").select("p_partkey", S.health_categories(h, u, n).cast("int").alias("by_category"), S.health_ratios(u / 10, h / 10, n).cast("int").alias("by_ratio"))


@query("SELECT p_partkey, CASE WHEN p_size <= 6 THEN 1 WHEN p_size <= 9 THEN 2 WHEN p_size <= 12 THEN 3 WHEN p_size <= 15 THEN 4 ELSE 5 END AS five, CASE WHEN p_size <= 6 THEN 1 WHEN p_size <= 12 THEN 3 ELSE 5 END AS three, least(5, 1 + CASE WHEN p_size * 4 > 120 THEN 2 WHEN p_size * 4 > 60 THEN 1 ELSE 0 END + CASE WHEN p_size > 15 THEN 1 ELSE 0 END + CASE WHEN p_size > 10 THEN 1 ELSE 0 END) AS additive FROM part")
def effort_level_variants(t):
    n = F.col("p_size")
    return t("part").select("p_partkey", S.effort_five(n).alias("five"), S.effort_three(n).alias("three"), S.effort_additive(n * 4, n, n).alias("additive"))


@query(f"SELECT category, severity, count(*) AS n FROM (SELECT unnest([x for x in [CASE WHEN title = '' THEN 'title/error' END, CASE WHEN len(items) < 2 THEN 'items/error' END, CASE WHEN len(steps) < 1 THEN 'steps/error' END, CASE WHEN servings = 0 THEN 'servings/warning' END, CASE WHEN prep = 0 AND cook = 0 THEN 'times/warning' END, CASE WHEN description = '' THEN 'description/info' END] if x IS NOT NULL]) AS note, split_part(note, '/', 1) AS category, split_part(note, '/', 2) AS severity FROM {RECORD}) GROUP BY ALL")
def validation_notes(t):
    return record(t).select(F.inline(S.notes(fields()))).groupBy("category", "severity").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(least(100, 60 + CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 15 ELSE 5 END + CASE WHEN split_part(text, chr(10), 2) <> '' THEN 3 ELSE 0 END + CASE WHEN n_chars % 60 <> 0 THEN 2 ELSE 0 END) AS INTEGER) AS confidence FROM documents")
def extraction_confidence(t):
    bonus = F.when(F.col("lang") == "en", 20).when(F.col("lang") == "de", 15).otherwise(5)
    p = S.points((F.split_part("text", F.lit("\n"), F.lit(2)) != "", 3), (F.col("n_chars") % 60 != 0, 2))
    return t("documents").select("doc_id", F.least(F.lit(100), 60 + bonus + p).cast("int").alias("confidence"))
