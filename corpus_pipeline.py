"""Documents to training sequences: STAGES in order, each one's output written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_templates, near_copies, packing, quality_rules, suffix_dedup
from quern.llm.common import documents, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text has them now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs).select("doc_id", "text", "lang", "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for the first document that has them."""
    return _measured(line_templates.drop_recurring(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more) stays."""
    return near_copies.keep_one(docs).select("doc_id", "text", "lang", "source", "n_chars")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that an earlier document has, or the same one earlier, go."""
    return _measured(suffix_dedup.remove_repeats(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its place in a sequence of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("suffix_dedup", passages), ("packing", sequences)]

#: Expectation-maximisation, fingerprint components and packing aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = table(docs, name)
    return docs
