"""Sources and sinks: site lists, logs, registries, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import host

SITES = "category string, name string, url string, sitemap string, sub_sitemaps string"
FAILURES = "timestamp timestamp, website string, url string, failure_type string, error_message string, status_code int, category string"


def site_list(spark: SparkSession, path: str, schema: str = SITES) -> DataFrame:
    """A CSV site list with a header: blanks trimmed, sub-sitemaps split at semicolons, bad rows out, the first row of each host in order of file and line."""
    rows = spark.read.csv(path, schema=schema, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    # a file's splits lie in order of their first byte, and the numbers of a split's rows rise
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    rows = rows.withColumn("_seq", place).withColumn("host", host(F.col("url"))).where(F.col("host").isNotNull())
    n = F.row_number().over(Window.partitionBy("host").orderBy("_seq"))
    subs = F.filter(F.transform(F.split(F.coalesce("sub_sitemaps", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn("_n", n).where("_n = 1").drop("_n", "_seq").withColumn("sub_sitemaps", subs)


def priority(category: Column, listed: Column) -> Column:
    """The listed priority, else one by category."""
    low = F.lower(category)
    guess = F.when(F.contains(low, F.lit("major")), 10).when(F.contains(low, F.lit("popular")), 8).otherwise(5)
    return F.coalesce(listed, guess)


def positional_sites(spark: SparkSession, path: str) -> DataFrame:
    """Eight columns by position; rows with fewer than four are out; "www." goes."""
    names = ["name", "url", "category", "host", "sitemap", "notes", "priority", "crawlable"]
    rows = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), header=False, quote='"', escape='"', mode="PERMISSIVE")
    return rows.where(F.col("host").isNotNull()).withColumn("host", F.regexp_replace("host", r"^www\.", "")).withColumn("crawlable", F.lit(True))


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that don't parse are out."""
    rows = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object by domain to rows."""
    entry = "struct<domain: string, url: string, reason: string, firstFailedAt: timestamp, lastAttemptAt: timestamp, attemptCount: int, errorType: string, isTemporary: boolean, cooldownUntil: timestamp>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {entry}>")).alias("key", "entry")).select("entry.*")


def save_registry(entries: DataFrame, path: str) -> None:
    """Rows with ``domain`` as one JSON object by domain, which is the registry's format."""
    pairs = F.collect_list(F.struct(F.col("domain").alias("key"), F.struct(*entries.columns).alias("value")))
    entries.agg(F.to_json(F.map_from_entries(F.array_sort(pairs))).alias("value")).coalesce(1).write.text(path)


def unblocked(urls: DataFrame, url: str, blocks: DataFrame, now: Column) -> DataFrame:
    """Rows whose host has no block, or a temporary one past its time."""
    live = blocks.where(~(F.coalesce("isTemporary", F.lit(False)) & F.coalesce(F.col("cooldownUntil") < now, F.lit(False)))).select(F.col("domain").alias("_host"))
    return urls.withColumn("_host", host(F.col(url))).join(live, "_host", "left_anti").drop("_host")


def robots_sitemaps(text: Column) -> Column:
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.startswith(F.lower(F.trim(x)), F.lit("sitemap:")))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?i)^\s*sitemap:", "")))


def export_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON; quotes doubled."""
    flat = [F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in df.dtypes]
    df.select(*flat).write.csv(path, header=True, quote='"', escape='"', quoteAll=True)


# Columns of the records' export.
EXPORTED = ("id", "title", "description", "cuisine_type", "servings", "prep_time", "cook_time", "total_time", "difficulty_level", "health_score", "source_url", "created_at")
# End of fixed values.


def record_lines(df: DataFrame, columns: tuple[str, ...] = EXPORTED) -> DataFrame:
    """A line of CSV for each row, values as JSON; null, zero and empty are an empty string."""
    kinds = dict(df.dtypes)

    def quoted(c: str):
        value = F.col(c)
        if kinds[c] == "string":
            return F.regexp_extract(F.to_json(F.array(F.coalesce(value, F.lit("")))), r"(?s)^\[(.*)\]$", 1)
        return F.when(value.isNull() | (value == 0), '""').otherwise(value.cast("string"))

    return df.select(F.concat_ws(",", *map(quoted, columns)).alias("line"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def export_by_category(df: DataFrame, category: str, path: str) -> DataFrame:
    """JSON lines in a folder for each category; returns the counts."""
    df.write.partitionBy(category).json(path)
    return df.groupBy(category).agg(F.count("*").alias("n"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of image files; their bytes are read only if selected."""
    return spark.read.format("binaryFile").load(path)


def database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def visible(df: DataFrame, owner: Column, public: Column, user: str) -> DataFrame:
    """Row-level access: public rows and the user's own."""
    return df.where(public | (owner == user))
