"""Merge, cascade and write queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merge as M
from .registry import query

SOURCE = "(SELECT conv_id, turn, 100 - (turn * 37) % 50 AS confidence, CASE WHEN role = 'system' THEN '' ELSE role END AS role, CASE WHEN length(text) > 300 THEN text ELSE '' END AS text, [role, CAST(turn % 3 AS VARCHAR)] AS tags, [y for y in [trim(x) for x in string_split(text, chr(10))] if y <> ''] AS items FROM conversations)"


def source(t):
    return t("conversations").select(
        "conv_id", "turn", (100 - (F.col("turn") * 37) % 50).alias("confidence"), F.when(F.col("role") == "system", "").otherwise(F.col("role")).alias("role"),
        F.when(F.length("text") > 300, F.col("text")).otherwise("").alias("text"), F.array("role", (F.col("turn") % 3).cast("string")).alias("tags"), T.lines(F.col("text")).alias("items"),
    )


@query(f"""SELECT m.conv_id, m.role, m.text, m.n_items, m.confidence, u.tags FROM (SELECT conv_id, arg_min(role, (-confidence, turn)) FILTER (role <> '') AS role, arg_min(text, (-confidence, turn)) FILTER (text <> '') AS text, CAST(max(len(items)) AS INTEGER) AS n_items, CAST(floor(avg(confidence) + 0.5) AS BIGINT) AS confidence FROM {SOURCE} GROUP BY conv_id) m
  JOIN (SELECT conv_id, string_agg(tag, '|' ORDER BY first) AS tags FROM (SELECT conv_id, tag, min(o) AS first FROM (SELECT conv_id, unnest(tags) AS tag, generate_subscripts(tags, 1) + 1000 * row_number() OVER (PARTITION BY conv_id ORDER BY confidence DESC, turn) AS o FROM {SOURCE}) GROUP BY ALL) GROUP BY conv_id) u USING (conv_id)""")
def coalesce_merge(t):
    merged = M.coalesced(source(t), "conv_id", "confidence", "turn", ["role", "text"], "tags", ["items"])
    return merged.select("conv_id", "role", "text", F.size("items").alias("n_items"), "confidence", F.array_join("tags", "|").alias("tags"))


LIMITS = [80.0, 80.0, 80.0, 70.0, 65.0]


@query("""SELECT conv_id, turn, coalesce(best, -1) < CASE WHEN turn < 3 THEN 80 WHEN turn = 3 THEN 70 ELSE 65 END AS asked FROM (SELECT conv_id, turn, max(length(text) % 90) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM conversations)""")
def source_cascade_mask(t):
    rows = t("conversations").select("conv_id", "turn", (F.length("text") % 90).alias("complete"))
    return M.consulted(rows, "conv_id", "turn", "complete", LIMITS).select("conv_id", "turn", "asked")


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1>([^<]+)</h1>', 1), ''), nullif(regexp_extract(html, '<title>([^<]+)</title>', 1), ''), 'none') AS title FROM pages")
def method_cascade(t):
    found = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return t("pages").select("page_id", M.cascade(found("<h1>([^<]+)</h1>"), found("<title>([^<]+)</title>"), F.lit("none")).alias("title"))


def two_lists(t):
    rows = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("r"))
    return rows.select("conv_id", T.lines(F.element_at("r.text", 1)).alias("a"), T.lines(F.element_at("r.text", -1)).alias("b"))


def sql_merge(cut, needs, both_ways):
    """A fold in SQL: lists of lists, the first being the base and the others one item each."""
    short = (lambda x: f"left(lower({x}), {cut})") if cut else (lambda x: f"lower({x})")
    other = f" OR contains({short('x[1]')}, {short('y')})" if both_ways else ""
    fits = f" OR NOT regexp_matches(lower(x[1]), '{needs}')" if needs else ""
    return f"CAST(len(list_reduce([a] || [[z] for z in b], lambda acc, x: CASE WHEN len([y for y in acc if contains(lower(y), {short('x[1]')}){other}]) > 0{fits} THEN acc ELSE acc || x END)) AS INTEGER)"


@query(f"""WITH l AS (SELECT conv_id, turn, [y for y in [trim(x) for x in string_split(text, chr(10))] if y <> ''] AS l, text FROM conversations), p AS (SELECT conv_id, arg_min(l, (turn, text)) AS a, arg_max(l, (turn, text)) AS b FROM l GROUP BY conv_id)
  SELECT conv_id, {sql_merge(None, None, False)} AS plain, {sql_merge(20, 'the|der|les|los', False)} AS steps, {sql_merge(30, 'the|der|les|los', True)} AS both_ways FROM p""")
def list_merge(t):
    a, b = F.col("a"), F.col("b")
    return two_lists(t).select("conv_id", F.size(M.not_contained(a, b)).alias("plain"), F.size(M.not_contained(a, b, "the|der|les|los", 20)).alias("steps"), F.size(M.not_contained(a, b, "the|der|les|los", 30, True)).alias("both_ways"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS DOUBLE) AS price FROM orders UNION ALL SELECT -1, 5.0")
def upsert_last_write(t):
    base = t("orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(0).alias("v"))
    batch = base.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("price") * 2).alias("price"), F.lit(1).alias("v")).union(t.rows([(-1, 5.0, 1)], "o_orderkey long, price double, v int"))
    return M.upsert(base, batch, "o_orderkey", "v").select("o_orderkey", "price")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, 1, round(sum(l_quantity), 2) FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1")
def replace_children(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = rows.where("l_orderkey % 5 = 0").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("l_quantity")).select("l_orderkey", F.lit(1).alias("l_linenumber"), "l_quantity")
    return M.replace_children(rows, new, "l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def delete_by_key(t):
    o = t("orders")
    return M.delete(o.select("o_orderkey"), o.where("o_orderstatus = 'F'"), "o_orderkey")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn DESC) AS text FROM conversations WHERE text <> '' GROUP BY 1")
def prioritised_concat(t):
    rows = t("conversations").where("text <> ''").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text")), asc=False).alias("r"))
    return rows.select("conv_id", F.array_join("r.text", "\n").alias("text"))
