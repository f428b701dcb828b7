"""The operators put together: records in, scored and merged records out; and hooks for functions of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import items as I
from ..functions import scores as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import dedup as D
from ..operators import merge as M
from .merging import LIMITS, source
from .registry import query
from .scoring import fields, record

Stage = Callable[[DataFrame], DataFrame]


class Hooks:
    """Named functions by kind (scrape, parse, enrich, validate), applied in the order in which they were added."""

    KINDS = ("scrape", "parse", "enrich", "validate")

    def __init__(self) -> None:
        self.stages: dict[str, list[tuple[str, Stage]]] = {k: [] for k in self.KINDS}

    def add(self, kind: str, name: str, stage: Stage) -> None:
        self.stages[kind].append((name, stage))

    def run(self, df: DataFrame) -> DataFrame:
        for kind in self.KINDS:
            for _, stage in self.stages[kind]:
                df = stage(df)
        return df


def model_hook(call: Callable[[pd.DataFrame], pd.Series], name: str, kind: str) -> Stage:
    """A stage that adds what a model says of each batch of rows."""

    def stage(df: DataFrame) -> DataFrame:
        ddl = ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes), f"`{name}` {kind}"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(**{name: call(batch)})

        return df.mapInPandas(run, ddl)

    return stage


def enriched(records: DataFrame, r: dict[str, Column], themes: C.Dictionary) -> DataFrame:
    """Cleaned titles, defaults, categories, times and scores in one projection."""
    fixed, lists = S.fixed(r), I.defaults(r)
    return records.select(
        "*", T.clean_title(r["title"]).alias("clean_title"), lists["cuisines"].alias("cuisine_names"), C.first_category(r["title"], themes).alias("category"),
        fixed["servings"].alias("final_servings"), fixed["changed"].alias("fixed"), F.round(S.quality(r, F.lit(True)), 6).alias("quality_score"),
        S.completeness_a(r).alias("completeness"), S.classification(F.concat_ws(" ", r["title"], r["description"])).alias("data_class"),
    )


def screened(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages that may be used: a URL, and no restriction."""
    screen = U.compliance(F.col(url))
    return pages.where(F.col(url).rlike("^https?://") & screen["can_scrape"])


@query()
def record_workflow(t):
    rows = enriched(record(t), fields(), {"english": ("the",), "german": ("und", "der")})
    valid = rows.where((F.col("title") != "") & (F.size("items") >= 1) & (F.size("steps") >= 1))
    kept = D.first_of_key(valid, F.nullif(T.title_key(F.col("title")), F.lit("")), "doc_id")
    return kept.select("doc_id", "clean_title", "category", "final_servings", "quality_score", "completeness", "data_class")


@query()
def source_aggregation(t):
    """Candidates of a conversation: those that the cascade asks, each text once, merged by confidence."""
    asked = M.consulted(source(t).withColumn("complete", F.length("text") % 90), "conv_id", "turn", "complete", LIMITS).where("asked")
    n = F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn"))
    unique = asked.withColumn("_n", n).where("_n = 1").drop("_n")
    return M.coalesced(unique, "conv_id", "confidence", "turn", ["role", "text"], "tags", ["items"]).select("conv_id", "role", F.length("text").alias("length"), "confidence", F.array_join("tags", "|").alias("tags"))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://') AND NOT regexp_matches(lower(url), 'subscription|premium|members-only|subscriber|paid-content|paywall|register|login-required|professional-photography|food-photography')")
def screened_pages(t):
    return screened(t("pages")).select("page_id")
