"""Aggregations and windows of the reports: counts by key, shares, latest rows, running figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def micros(ts: str) -> Column:
    """Microseconds since 1970, for timestamps with or without a time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in ``order``; Spark limits each key's rows before the shuffle."""
    names = [c for c in df.columns if c != key]
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", number).where("_n = 1").select(key, *names)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def share_of(df: DataFrame, within: str, key: str) -> DataFrame:
    """Count of each key within a group, and its share of the group."""
    counts = df.groupBy(within, key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(within))
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def success_rates(df: DataFrame, key: str, ok: Column, limited: Column, refused: Column) -> DataFrame:
    """Attempts, successes, errors by kind and success rate of each key."""
    other = ~ok & ~limited & ~refused
    return df.groupBy(key).agg(
        F.count("*").alias("attempts"), F.count_if(ok).alias("successes"), F.count_if(limited).alias("limited"), F.count_if(refused).alias("refused"),
        F.count_if(other).alias("other"), F.round(F.count_if(ok) / F.count("*"), 6).alias("rate"),
    )


def running_mean(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("mean", F.avg(value).over(w))


def gap_since_previous(df: DataFrame, key: str, ts: str, *order: str) -> DataFrame:
    before = F.lag(micros(ts)).over(Window.partitionBy(key).orderBy(ts, *order))
    return df.withColumn("gap_us", micros(ts) - before)


def trailing_count(df: DataFrame, key: str, ts: str, span_us: int, hit: Column) -> DataFrame:
    """Hits in the ``span_us`` microseconds up to each row, the far edge left out."""
    w = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-span_us + 1, 0)
    return df.withColumn("recent", F.sum(hit.cast("long")).over(w))


def last_n(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def zero_filled(counts: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """A row for each class, those without rows with 0."""
    return classes.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def paged(df: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """A page of rows, each with the count of all."""
    total = df.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("_k", F.lit(1))
    return rows.join(F.broadcast(total), "_k").drop("_k")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``number``, from 1 in ``order``: sorted over range partitions, which get each other's counts, a row for each."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("n")).select("_p", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("_m"))
    return ranged.join(counts, "_p").withColumn("number", F.col("_before") + own).drop("_p", "_m", "_before")


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by the hash of seed and key: the same ones however the rows are partitioned."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


# Ordered patterns of messages.
PATTERNS = (("timeout", "Network Timeout"), ("failed to fetch", "Fetch Error"), ("json-ld", "JSON-LD Parsing Error"), ("validation failed", "QA Validation Failed"), ("selector", "HTML Selector Error"), ("404", "404 Not Found"), ("50", "Server Error (5xx)"))
REGISTRY = (("cloudflare|cf-ray", "cloudflare"), ("captcha", "captcha"), ("403|forbidden|unauthorized", "authentication"), ("429|rate limit", "rate_limit"), ("timeout|timed out", "timeout"), ("parse|invalid|format", "invalid_format"))
CRAWL = (("429|rate limit", "rate_limit"), ("403|forbidden", "forbidden"), ("timeout", "timeout"))
OPERATION = (("timeout", "timeout"), ("403|forbidden", "bot_detection"), ("429|rate limit", "rate_limit"), ("parse|extract", "parsing_error"))
# End of fixed values.


def first_pattern(message: Column, patterns: tuple[tuple[str, str], ...], default: str) -> Column:
    return F.coalesce(*(F.when(message.rlike(p), name) for p, name in patterns), F.lit(default))


def error_pattern(message: Column) -> Column:
    """Any "50" counts as a server error."""
    return first_pattern(F.lower(message), PATTERNS, "Unknown Error")


def registry_error(message: Column) -> Column:
    return first_pattern(F.lower(message), REGISTRY, "other")


def operation_error(message: Column) -> Column:
    """Case matters here."""
    return first_pattern(message, OPERATION, "http_error")


def crawl_error(message: Column) -> Column:
    """Case matters here, too."""
    return first_pattern(message, CRAWL, "unknown")
