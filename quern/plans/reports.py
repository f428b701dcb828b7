"""Report, window, sort and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import report as R
from .registry import query

MESSAGE = "event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || CASE event_type WHEN 'error' THEN ' timeout' WHEN 'click' THEN ' failed to fetch' WHEN 'view' THEN ' forbidden' ELSE '' END"


def messages(t):
    tail = F.when(F.col("event_type") == "error", " timeout").when(F.col("event_type") == "click", " failed to fetch").when(F.col("event_type") == "view", " forbidden").otherwise("")
    return t("events").withColumn("message", F.concat("event_type", F.lit(" "), F.floor("value").cast("string"), tail))


@query("""SELECT user_id, n, last_event FROM (SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM events WHERE event_type = 'error' GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 10""")
def error_report_by_key(t):
    rows = t("events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
    return R.top(rows, 10, F.desc("n"), F.col("user_id"))


@query(f"SELECT message, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM (SELECT *, {MESSAGE} AS message FROM events) GROUP BY message")
def qa_log_groups(t):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return messages(t).groupBy("message").agg(F.count("*").alias("n"), ids.alias("ids"))


@query(f"""SELECT CASE WHEN regexp_matches(m, 'timeout') THEN 'Network Timeout' WHEN regexp_matches(m, 'failed to fetch') THEN 'Fetch Error' WHEN regexp_matches(m, '404') THEN '404 Not Found' WHEN regexp_matches(m, '50') THEN 'Server Error (5xx)' ELSE 'Unknown Error' END AS pattern,
  CASE WHEN regexp_matches(m, '403|forbidden') THEN 'authentication' WHEN regexp_matches(m, '429') THEN 'rate_limit' WHEN regexp_matches(m, 'timeout') THEN 'timeout' ELSE 'other' END AS kind,
  CASE WHEN contains(m, 'timeout') THEN 'timeout' WHEN regexp_matches(m, '403|forbidden') THEN 'bot_detection' WHEN contains(m, '429') THEN 'rate_limit' ELSE 'http_error' END AS operation, count(*) AS n FROM (SELECT {MESSAGE} AS m FROM events) GROUP BY ALL""")
def qa_log_patterns(t):
    m = F.col("message")
    return messages(t).groupBy(R.error_pattern(m).alias("pattern"), R.registry_error(m).alias("kind"), R.operation_error(m).alias("operation")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN contains(m, '429') OR contains(m, 'rate limit') THEN 'rate_limit' WHEN contains(m, '403') OR contains(m, 'forbidden') THEN 'forbidden' WHEN contains(m, 'timeout') THEN 'timeout' ELSE 'unknown' END AS kind, count(*) AS n FROM (SELECT {MESSAGE} AS m FROM events) GROUP BY 1")
def crawl_errors(t):
    return messages(t).groupBy(R.crawl_error(F.col("message")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS kind, count(*) FILTER (value < 50) AS temporary, count(*) FILTER (value >= 50) AS permanent, count(*) AS total FROM events WHERE event_type IN ('error', 'click', 'signup') GROUP BY ROLLUP (event_type)")
def block_statistics(t):
    """Blocks by kind of error and together; small values stand for temporary ones."""
    rows = t("events").where(F.col("event_type").isin("error", "click", "signup"))
    sums = rows.rollup("event_type").agg(F.count_if(F.col("value") < 50).alias("temporary"), F.count_if(F.col("value") >= 50).alias("permanent"), F.count("*").alias("total"), F.grouping("event_type").alias("g"))
    return sums.select(F.when(F.col("g") == 1, "all").otherwise(F.col("event_type")).alias("kind"), "temporary", "permanent", "total")


@query("SELECT user_id, count(*) AS requests, CASE WHEN count(*) > 0 THEN printf('%.2f', count(*) FILTER (event_type = 'view') * 100.0 / count(*)) || '%' ELSE '0%' END AS hit_rate FROM events GROUP BY 1")
def hit_rates(t):
    hits = F.count_if(F.col("event_type") == "view")
    # format_number rounds the double's exact value, halves to even, as C's printf does; format_string rounds halves up
    return t("events").groupBy("user_id").agg(F.count("*").alias("requests"), F.concat(F.format_number(hits * 100.0 / F.count("*"), 2), F.lit("%")).alias("hit_rate"))


@query("SELECT CASE WHEN grouping(event_type) = 0 THEN event_type ELSE 'hour ' || h END AS key, count(*) AS n FROM (SELECT event_type, CAST(hour(ts) AS VARCHAR) AS h FROM events) GROUP BY GROUPING SETS ((event_type), (h))")
def qa_log_one_pass(t):
    rows = t("events").select("event_type", F.hour("ts").cast("string").alias("h"))
    sets = rows.groupingSets([["event_type"], ["h"]], "event_type", "h").agg(F.count("*").alias("n"), F.grouping("event_type").alias("g"))
    return sets.select(F.when(F.col("g") == 0, F.col("event_type")).otherwise(F.concat(F.lit("hour "), "h")).alias("key"), "n")


RATES = "SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type IN ('view', 'purchase')) AS successes, count(*) FILTER (event_type = 'error') AS limited, count(*) FILTER (event_type = 'click') AS refused, count(*) FILTER (event_type = 'signup') AS other, round(count(*) FILTER (event_type IN ('view', 'purchase')) / count(*), 6) AS rate FROM events GROUP BY user_id"


def rates(t):
    e = F.col("event_type")
    return R.success_rates(t("events"), "user_id", e.isin("view", "purchase"), e == "error", e == "click")


@query(RATES)
def key_success_rates(t):
    return rates(t)


@query(f"SELECT CASE WHEN rate > 0.5 THEN 'successful' WHEN rate > 0 THEN 'problematic' ELSE 'none' END AS bucket, count(*) AS n FROM ({RATES}) GROUP BY 1")
def key_buckets(t):
    bucket = F.when(F.col("rate") > 0.5, "successful").when(F.col("rate") > 0, "problematic").otherwise("none")
    return R.counts_by(rates(t).withColumn("bucket", bucket), "bucket")


@query(f"SELECT user_id, rate, attempts FROM ({RATES}) WHERE rate < 0.5 ORDER BY rate, user_id LIMIT 10")
def problem_keys(t):
    return R.top(rates(t).where("rate < 0.5").select("user_id", "rate", "attempts"), 10, F.col("rate"), F.col("user_id"))


@query(f"SELECT user_id, rate, attempts FROM ({RATES}) WHERE rate >= 0.4 AND attempts >= 5 ORDER BY attempts DESC, user_id LIMIT 10")
def top_performers(t):
    return R.top(rates(t).where("rate >= 0.4 AND attempts >= 5").select("user_id", "rate", "attempts"), 10, F.desc("attempts"), F.col("user_id"))


@query("""WITH r AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY ALL)
  SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM r""")
def error_share_window(t):
    e = t("events")
    recent = e.join(F.broadcast(e.agg(F.max("ts").alias("top"))), F.col("ts") > F.col("top") - F.expr("INTERVAL 7 DAY"))
    return R.share_of(recent, "user_id", "event_type")


@query("SELECT event_id, count(*) OVER w AS n, CAST(round(avg(value) OVER w * count(*) OVER w * 100) AS BIGINT) AS cents FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_mean(t):
    rows = R.running_mean(t("events"), "user_id", "value", "ts", "event_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return rows.withColumn("n", n).select("event_id", "n", F.round(F.col("mean") * F.col("n") * 100).cast("long").alias("cents"))


@query("SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events")
def gap_since_prev(t):
    return R.gap_since_previous(t("events"), "user_id", "ts", "event_id").select("event_id", "gap_us")


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events")
def trailing_failures(t):
    return R.trailing_count(t("events"), "user_id", "ts", 7 * 86_400_000_000, F.col("event_type") == "error").select("event_id", "recent")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def last_n_per_key(t):
    return R.last_n(t("events"), "user_id", 20, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS BIGINT) AS chunk FROM orders")
def chunk_ids(t):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t("orders").select("o_custkey", "o_orderkey", F.floor((n - 1) / 5).alias("chunk"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_per_key(t):
    return R.latest(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total, floor(avg(l_quantity) + 0.5)::BIGINT AS mean, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS discounted, strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last FROM lineitem GROUP BY l_returnflag")
def storage_statistics(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t("lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.floor(F.avg("l_quantity") + 0.5).alias("mean"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"), day(F.min("l_shipdate")).alias("first"), day(F.max("l_shipdate")).alias("last"),
    )


@query("SELECT l_returnflag, round(sum(l_extendedprice) / 1e6, 2) AS size, round(coalesce(sum(l_extendedprice * l_discount), 0) / 1e6, 2) AS saved, round(coalesce(sum(l_extendedprice * l_discount), 0) / nullif(sum(l_extendedprice), 0) * 100, 2) AS percent FROM lineitem GROUP BY l_returnflag")
def storage_savings(t):
    saved = F.coalesce(F.sum(F.col("l_extendedprice") * F.col("l_discount")), F.lit(0.0))
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice") / 1e6, 2).alias("size"), F.round(saved / 1e6, 2).alias("saved"), F.round(saved / F.nullif(F.sum("l_extendedprice"), F.lit(0.0)) * 100, 2).alias("percent"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def largest_rows(t):
    return R.top(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 20, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1996-01-02' GROUP BY 1")
def daily_counts(t):
    return R.counts_by(t("orders").where("to_date(o_orderdate) = DATE '1996-01-02'"), "o_orderstatus")


@query("SELECT count(*) AS n, round(avg(coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 0)), 4) AS mean_all, count(DISTINCT nullif(o_orderpriority, '')) AS priorities, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders ORDER BY p LIMIT 10)) AS first_ten FROM orders")
def global_statistics(t):
    ten = F.array_join(F.slice(F.sort_array(F.collect_set("o_orderpriority")), 1, 10), ",")
    filled = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), F.lit(0.0))
    return t("orders").agg(F.count("*").alias("n"), F.round(F.avg(filled), 4).alias("mean_all"), F.count_distinct(F.nullif("o_orderpriority", F.lit(""))).alias("priorities"), ten.alias("first_ten"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged_with_total(t):
    return R.paged(t("orders").select("o_orderkey", "o_orderdate"), 3, 20, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", "total")


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(coalesce(nullif(l_tax, 0), 0)), 4) AS tax FROM lineitem GROUP BY 1")
def totals_per_parent(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.lit(0.0))), 4).alias("tax"))


@query("SELECT source, count(*) AS n, count(quality) AS scored, round(avg(quality), 6) AS mean, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS flagged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def operation_summary(t):
    rows = t("documents").join(t("labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("scored"), F.round(F.avg("quality"), 6).alias("mean"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("flagged"))


@query("SELECT source, lang, count(*) AS n, floor(avg(n_chars) + 0.5)::BIGINT AS mean_chars, count(*) FILTER (n_chars > 2000) AS long_ones FROM documents GROUP BY ALL")
def source_statistics(t):
    return t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.floor(F.avg("n_chars") + 0.5).alias("mean_chars"), F.count_if(F.col("n_chars") > 2000).alias("long_ones"))


@query("SELECT c.class, coalesce(n, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) c(class) LEFT JOIN (SELECT o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1) USING (class)")
def class_breakdown(t):
    classes = t.rows([("F",), ("O",), ("P",), ("X",)], "class string")
    return R.zero_filled(R.counts_by(t("orders").withColumnRenamed("o_orderstatus", "class"), "class"), classes, "class")


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE) + 365, DATE '1998-01-01') AS overdue FROM orders WHERE CAST(o_orderdate AS DATE) + 365 < DATE '1998-01-01'")
def retention_violations(t):
    due = F.date_add(F.to_date("o_orderdate"), 365)
    return t("orders").where(due < F.lit("1998-01-01").cast("date")).select("o_orderkey", F.datediff(F.lit("1998-01-01").cast("date"), due).cast("long").alias("overdue"))


@query("SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS pages FROM pages GROUP BY 1")
def urls_by_host(t):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("page_id")), lambda x: x.cast("string")), ",")
    return t("pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), ids.alias("pages"))


@query("SELECT event_type, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(count(*) / 30.0, 6)::DOUBLE AS per_day FROM events GROUP BY 1")
def timing_statistics(t):
    return t("events").groupBy("event_type").agg(F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.count("*") / 30.0, 6).alias("per_day"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1) SELECT CAST(sum(ok) AS BIGINT) AS successes, count(*) FILTER (ok * 2 < n) AS failed_sites, count(*) AS sites, round(sum(ok) / sum(n) * 100, 4) AS rate FROM s""")
def batch_results(t):
    s = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"))
    return s.agg(F.sum("ok").alias("successes"), F.count_if(F.col("ok") * 2 < F.col("n")).alias("failed_sites"), F.count("*").alias("sites"), F.round(F.sum("ok") / F.sum("n") * 100, 4).alias("rate"))


@query("SELECT p_partkey, p_name FROM part WHERE p_type = (SELECT min(p_type) FROM part) ORDER BY p_size DESC, p_partkey LIMIT 10")
def category_items(t):
    p = t("part")
    first = p.agg(F.min("p_type").alias("p_type"))
    return R.top(p.join(F.broadcast(first), "p_type"), 10, F.desc("p_size"), F.col("p_partkey")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part ORDER BY CASE WHEN p_size % 7 = 0 THEN 10 ELSE p_size END, p_name, p_partkey LIMIT 50")
def multi_key_sort(t):
    order = F.coalesce(F.when(F.col("p_size") % 7 != 0, F.col("p_size")), F.lit(10))
    return t("part").orderBy(order, "p_name", "p_partkey").limit(50).select("p_partkey")


@query("SELECT p_partkey FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR) || '7'), p_partkey LIMIT 25")
def hash_order_sample(t):
    return t("part").orderBy(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("7"))), "p_partkey").limit(25).select("p_partkey")


@query("SELECT p_partkey FROM part ORDER BY sha256('7:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 25")
def random_sample(t):
    return R.sampled(t("part"), "p_partkey", 25, 7).select("p_partkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30")
def offset_page(t):
    return t("orders").orderBy("o_orderkey").offset(30).limit(15).select("o_orderkey")


@query("SELECT p_name AS value FROM part UNION SELECT p_type FROM part")
def set_union(t):
    p = t("part")
    return p.select(F.col("p_name").alias("value")).union(p.select("p_type")).distinct()


@query("SELECT n_nationkey AS key FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION SELECT s_nationkey FROM supplier")
def pattern_union(t):
    n = t("nation").join(t("customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select(F.col("n_nationkey").alias("key"))
    return n.union(t("supplier").select("s_nationkey")).distinct()


@query("""WITH w AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents) SELECT doc_id, CAST(len(list_intersect(w, ['the', 'of', 'and', 'der', 'que'])) AS INTEGER) AS common FROM w""")
def set_intersect(t):
    w = F.split(F.lower("text"), " ")
    return t("documents").select("doc_id", F.size(F.array_intersect(w, F.array(*map(F.lit, ("the", "of", "and", "der", "que"))))).alias("common"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(t):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti").distinct()


@query("SELECT doc_id FROM documents d WHERE contains(lower(text), 'ring') OR contains(lower(source), 'src1') OR contains(lower(lang), 'fr')")
def multi_field_search(t):
    low = lambda c, s: F.contains(F.lower(c), F.lit(s))
    return t("documents").where(low("text", "ring") | low("source", "src1") | low("lang", "fr")).select("doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment IS NOT NULL")
def threshold_filter(t):
    return t("customer").where("c_acctbal >= 5000 AND c_mktsegment IS NOT NULL").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def key_filter(t):
    return t("orders").where("o_orderkey = 7").select("o_orderkey", "o_orderstatus")


@query("""SELECT doc_id, title <> '' AND n_lines >= 1 AND n_steps >= 1 AS valid, length(title) > 3 AND n_lines >= 2 AND n_steps >= 1 AS strict FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title,
  len([x for x in string_split(text, chr(10)) if trim(x) <> '']) AS n_lines, len([x for x in regexp_split_to_array(text, '[.!?]+') if trim(x) <> '']) AS n_steps FROM documents)""")
def record_validity(t):
    from ..functions.text import lines as split_lines

    title = F.split_part("text", F.lit("\n"), F.lit(1))
    steps = F.size(F.filter(F.split("text", "[.!?]+"), lambda x: F.trim(x) != ""))
    n = F.size(split_lines(F.col("text")))
    return t("documents").select("doc_id", ((title != "") & (n >= 1) & (steps >= 1)).alias("valid"), ((F.length(title) > 3) & (n >= 2) & (steps >= 1)).alias("strict"))


@query("SELECT conv_id, bool_and(length(text) >= 10) AS valid FROM conversations GROUP BY 1")
def workflow_validity(t):
    return t("conversations").groupBy("conv_id").agg(F.bool_and(F.length("text") >= 10).alias("valid"))
