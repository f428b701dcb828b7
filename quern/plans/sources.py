"""Queries that write files in the shared folder and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import new_folder
from ..sources import tables as S
from .registry import query


@query("""SELECT event_id, event_type, 'say "' || event_type || '", twice' AS note, round(value, 6) AS value FROM events""")
def failure_export(t):
    path = new_folder(t.spark)
    rows = t("events").select("event_id", "event_type", F.concat(F.lit('say "'), "event_type", F.lit('", twice')).alias("note"), "value")
    S.export_csv(rows, path)
    back = t.spark.read.csv(path, header=True, quote='"', escape='"', schema="event_id long, event_type string, note string, value double")
    return back.withColumn("value", F.round("value", 6))


@query("""SELECT CASE WHEN o_orderkey = 0 THEN '""' ELSE o_orderkey::VARCHAR END || ',' || to_json('Order "' || o_orderkey || '"') || ',"",' || to_json(o_orderpriority) || ',' || CASE WHEN o_custkey % 5 = 0 THEN '""' ELSE (o_custkey % 5)::VARCHAR END || ',7,"",7,"",' || CASE WHEN o_custkey = 0 THEN '""' ELSE o_custkey::VARCHAR END || ',' || to_json('http://a.com/' || o_orderkey) || ',' || to_json(strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')) AS line FROM orders""")
def record_export(t):
    path = new_folder(t.spark)
    key = F.col("o_orderkey").cast("string")
    rows = t("orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit('Order "'), key, F.lit('"')).alias("title"), F.lit(None).cast("string").alias("description"), F.col("o_orderpriority").alias("cuisine_type"),
        (F.col("o_custkey") % 5).alias("servings"), F.lit(7).alias("prep_time"), F.lit(0).alias("cook_time"), F.lit(7).alias("total_time"), F.lit("").alias("difficulty_level"),
        F.col("o_custkey").alias("health_score"), F.concat(F.lit("http://a.com/"), key).alias("source_url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
    )
    S.record_lines(rows).write.text(path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT p_type AS category, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part GROUP BY 1")
def category_export(t):
    path = new_folder(t.spark)
    S.export_by_category(t("part").select("p_partkey", "p_size", F.col("p_type").alias("category")), "category", path)
    back = t.spark.read.schema("p_partkey long, p_size long, category string").json(path)
    return back.groupBy("category").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


@query("SELECT event_id, event_type FROM events")
def log_append(t):
    """Two appends and a line that isn't JSON."""
    path = new_folder(t.spark)
    rows = t("events").select("event_id", "event_type")
    S.append_log(rows.where("event_id % 2 = 0"), path)
    S.append_log(rows.where("event_id % 2 = 1"), path)
    t.rows([("no json",)], "value string").write.mode("append").text(path)
    return S.json_log(t.spark, path, "event_id long, event_type string")


@query("SELECT page_id FROM pages WHERE regexp_extract(url, '^https?://([^/:?#]+)', 1) NOT IN (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) FROM pages WHERE page_id % 40 = 3)")
def registry_round_trip(t):
    """Hosts of some pages blocked for good, others for a time that is over."""
    path = new_folder(t.spark)
    hosts = t("pages").select(U.host(F.col("url")).alias("domain"), "page_id")
    for_good = hosts.where("page_id % 40 = 3").select("domain", F.lit(False).alias("isTemporary"), F.lit(None).cast("timestamp").alias("cooldownUntil")).distinct()
    over = hosts.where("page_id % 40 = 5").select("domain", F.lit(True), F.lit("2020-01-01").cast("timestamp")).distinct().join(for_good, "domain", "left_anti")
    S.save_registry(for_good.union(over), path)
    return S.unblocked(t("pages"), "url", S.registry(t.spark, path), F.lit("2024-01-01").cast("timestamp")).select("page_id")


SITES = "category,name,url,sitemap,sub\nMajor, A ,https://a.com/x,https://a.com/s.xml, s1 ; s2;\n,,,,\nother,Again,https://a.com/y,,\nPopular,B,https://www.b.org,,t1\nbad,C,no url,,\n"


@query("SELECT * FROM (VALUES ('A', 'a.com', 's1|s2', 10), ('B', 'www.b.org', 't1', 8)) v(name, host, subs, priority)")
def site_lists(t):
    path = new_folder(t.spark)
    t.rows([(SITES.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    sites = S.site_list(t.spark, path)
    return sites.select("name", "host", F.array_join("sub_sitemaps", "|").alias("subs"), S.priority(F.col("category"), F.lit(None).cast("int")).alias("priority"))


POSITIONAL = 'A,https://a.com,major,www.a.com,s.xml,"x, ""y""",3,false\nshort,https://b.com,c\nB,https://b.com,c,b.com'


@query("""SELECT * FROM (VALUES ('A', 'a.com', 'x, "y"', true), ('B', 'b.com', NULL, true)) v(name, host, notes, crawlable)""")
def positional_site_lists(t):
    path = new_folder(t.spark)
    t.rows([(POSITIONAL,)], "value string").coalesce(1).write.text(path)
    return S.positional_sites(t.spark, path).select("name", "host", "notes", "crawlable")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 100 = 7 AND l_linenumber <> 2 UNION ALL SELECT 7, 99, 1")
def image_rows(t):
    """Metadata rows of images: one put in, one of each record taken out, those of some records selected."""
    path = new_folder(t.spark)
    rows = t("lineitem").where("l_orderkey % 100 = 7").select("l_orderkey", "l_linenumber", "l_partkey")
    rows.write.parquet(path)
    t.rows([(7, 99, 1)], "l_orderkey long, l_linenumber int, l_partkey long").select(*(F.col(c).cast(k) for c, k in rows.dtypes)).write.mode("append").parquet(path)
    return t.spark.read.parquet(path).where("l_linenumber <> 2")
